"""Curating a case table: normalisation, enumerations, overrides, and audits that return rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import complete_date, digits_int, null_token
from ..functions.text import split_list


def normalise(cases: DataFrame, ints: list[str] = (), dates: list[str] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """Null tokens to null, numbers from their digits, partial dates completed, defaults for gaps."""
    for c in cases.columns:
        x = null_token(F.col(c).cast("string"))
        x = digits_int(x) if c in ints else complete_date(x) if c in dates else x
        if defaults and c in defaults:
            x = F.coalesce(x, F.lit(defaults[c]))
        cases = cases.withColumn(c, x)
    return cases


def enforce_domains(cases: DataFrame, domains: dict[str, list[str]], remaps: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Values outside a column's domain are remapped, split from their note, or kept.

    `VALUE (note)`, `VALUE note` and `VALUE+note` become VALUE with the note in <column>_detail; the
    longest value wins. A value that fits nothing stays, for domain_violations to report.
    """
    for c, domain in domains.items():
        x, allowed = F.col(c), F.col(c).isin(*domain)
        mapped = F.lit(None).cast("string")
        for old, new in ((remaps or {}).get(c) or {}).items():
            mapped = F.when(x == old, new).otherwise(mapped)
        noted, note = F.regexp_extract(x, r"^([A-Za-z_]+)\s*\((.+)\)\s*$", 1), F.regexp_extract(x, r"^([A-Za-z_]+)\s*\((.+)\)\s*$", 2)
        start, rest = F.lit(None).cast("string"), F.lit(None).cast("string")
        for value in sorted(domain, key=len):
            fits = x.startswith(value + " ") | x.startswith(value + "+")
            start, rest = F.when(fits, value).otherwise(start), F.when(fits, F.trim(F.substring(x, len(value) + 1, 10**6))).otherwise(rest)
        inside = noted.isin(*domain)
        out = F.when(x.isNull() | allowed, x).when(mapped.isNotNull(), mapped).when(inside, noted).when(start.isNotNull(), start).otherwise(x)
        detail = F.when(allowed | x.isNull(), None).when(mapped.isNotNull(), x).when(inside, note).otherwise(rest)
        cases = cases.select(*[F.col(k) for k in cases.columns if k not in (c, f"{c}_detail")], out.alias(c), detail.alias(f"{c}_detail"))
    return cases


def apply_overrides(cases: DataFrame, overrides: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """overrides (key, field, mode, value): `set` replaces (the last of several counts), `fill` fills a blank (the first), `append` adds to a list unless it is there (each).

    They are applied in this order of modes, and within one by `order`, a column of overrides, or by value. The
    changes of a key are one row, so the cases are joined once, whatever the number of columns.
    """
    place = F.col(order) if order else F.col("value")
    per = overrides.where(F.col("value").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col("value").alias("v"), F.col("field").alias("f"), F.col("mode").alias("m")))).alias("_changes"))
    joined = cases.join(per, key, "left")

    def blank(x: Column) -> Column:
        return x.isNull() | (F.trim(x) == "")

    def changed(c: str) -> Column:
        def of(mode: str) -> Column:
            return F.transform(F.filter("_changes", lambda x: (x["f"] == c) & (x["m"] == mode)), lambda x: x["v"])

        kind = cases.schema[c].dataType.simpleString()
        now = F.coalesce(F.try_element_at(of("set"), F.lit(-1)), F.col(c).cast("string"))
        now = F.when(blank(now), F.coalesce(F.try_element_at(of("fill"), F.lit(1)), now)).otherwise(now)
        now = F.aggregate(of("append"), now, lambda s, v: F.when(blank(s), v).when(F.contains(s, v), s).otherwise(F.concat(s, F.lit("; "), v)))
        return F.when(F.col("_changes").isNull(), F.col(c)).otherwise(now.cast(kind))

    return joined.select(*[F.col(c) if c == key else changed(c).alias(c) for c in cases.columns])


def drop_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in the columns."""
    return df.dropna(subset=columns)


def sorted_nulls_last(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def schema_violations(cases: DataFrame, key: str, year: str, status: str, statuses: list[str], years: tuple[int, int] = (2001, 2027)) -> DataFrame:
    """(rule, key, n): ids that are null or not unique, years out of range, and statuses out of their domain; n rows each. Further columns are allowed."""
    ids = cases.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    bad = ids.where("key is null").select(F.lit("id_is_null").alias("rule"), "key", "n").unionByName(ids.where("key is not null and n > 1").select(F.lit("id_is_unique").alias("rule"), "key", "n"))
    rules = {"year_in_range": F.col(year).between(*years), "status_in_domain": F.col(status).isin(*statuses)}
    rows = rule_violations(cases.withColumn("_key", F.col(key).cast("string")), "_key", {k: F.coalesce(c, F.lit(k == "status_in_domain")) for k, c in rules.items()})
    return bad.unionByName(rows.groupBy("rule", F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("n")))


def list_rows(df: DataFrame, key: str, column: str, value: str = "value", by: str = ";") -> DataFrame:
    """(key, position, value): one row a list part, positions from 0 after blanks are dropped."""
    return df.select(key, F.posexplode(split_list(F.col(column), by)).alias("position", value))


def keep_first(cases: DataFrame, key: str, order: list[str]) -> DataFrame:
    from .relational import top_per_key

    return top_per_key(cases, key, [F.col(o) for o in order], 1)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null, n_empty, n_filled, n_listed, n_unique, min_len, max_len, median_len): one pass for the sums, one for 128-bit hashes of the values."""
    stats = []
    for i, c in enumerate(columns):
        s = F.col(c).cast("string")
        stats += [F.count_if(s.isNull()).alias(f"n_null_{i}"), F.count_if(s == "").alias(f"n_empty_{i}"), F.count_if(s != "").alias(f"n_filled_{i}"), F.count_if(s.contains(";")).alias(f"n_listed_{i}"), F.min(F.char_length(s)).alias(f"min_len_{i}"), F.max(F.char_length(s)).alias(f"max_len_{i}"), F.median(F.char_length(s)).alias(f"median_len_{i}")]
    names = ("n_null", "n_empty", "n_filled", "n_listed", "min_len", "max_len", "median_len")
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{n}_{i}").cast("double" if n == "median_len" else "long").alias(n) for n in names]) for i, c in enumerate(columns)]
    sums = df.agg(*stats).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    unique = _hashed(df, columns).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    joined = sums.join(unique, "column", "left")
    return joined.select("column", "n_null", "n_empty", "n_filled", "n_listed", F.coalesce("n_unique", F.lit(0).cast("long")).alias("n_unique"), "min_len", "max_len", "median_len")


def _hashed(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, hash) of every value that is not null."""
    parts = [F.struct(F.lit(c).alias("column"), F.unhex(F.md5(F.col(c).cast("string"))).alias("hash")) for c in columns]
    return df.select(F.explode(F.array(*parts)).alias("r")).select("r.*").where("hash is not null")


def value_counts(df: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """(column, value, n) of the columns that hold up to `most` different values; nulls are left out."""
    n = _hashed(df, columns).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most)
    few = {r["column"] for r in n.collect()}  # a row a column
    parts = [df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column"), "value", "n") for c in columns if c in few]
    out = df.sparkSession.createDataFrame([], "`column` string, value string, n long")
    for p in parts:
        out = out.unionByName(p)
    return out


def bad_values(df: DataFrame, checks: dict[str, Column], n: int = 10) -> DataFrame:
    """(column, value, n): the most frequent values for which a column's check holds."""
    from .relational import top_per_key

    parts = [df.where(bad).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c, bad in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_per_key(out.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "column", [F.col("n").desc(), F.col("value")], n)


def not_integer(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "") & F.col(c).try_cast("bigint").isNull()


def not_date(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$")


def domain_violations(df: DataFrame, domains: DataFrame, column: str | list[str]) -> DataFrame:
    """(column, value, n): values of the columns that the domain table (column, value) lacks. One pass, whatever the number of columns."""
    columns = [column] if isinstance(column, str) else column
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")
    held = df.select(cells).select("r.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return held.join(domains.select("column", "value"), ["column", "value"], "left_anti").select("column", "value", "n")


def detail_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): how many rows of each column enforce_domains gave a detail."""
    return coverage(df, {c: F.col(f"{c}_detail").isNotNull() for c in columns}).select(F.col("check").alias("column"), "n")


def missing_required(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, column) for each required field that is null or absent."""
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) if c in df.columns else F.lit(c) for c in required]))
    return df.select(key, F.explode(gaps).alias("column"))


def missing_summary(df: DataFrame, key: str, required: list[str], first: int = 10) -> DataFrame:
    """(column, n, ids): how many rows lack a required field, and the `first` smallest of their ids."""
    from .relational import top_per_key

    gaps = missing_required(df, key, required)
    few = top_per_key(gaps, "column", [F.col(key)], first).groupBy("column").agg(F.array_sort(F.collect_list(key)).alias("ids"))
    return gaps.groupBy("column").agg(F.count(F.lit(1)).alias("n")).join(few, "column")


def rule_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key): rows for which a rule is false; a rule that is null holds. One pass, whatever the number of rules."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), key)


def case_rules(total: str, excluded: str, died: str, casualties: str, year: str, date: str, status: str, manifesto: str, manifesto_fields: list[str]) -> dict[str, Column]:
    """The seven rules between the fields of one case."""
    n, m = F.col(total), F.col(excluded)
    empty = F.lit(True)
    for c in manifesto_fields:
        empty = empty & F.col(c).isNull()
    return {
        "total_at_least_excluded": n >= m,
        "died_means_more": F.when(F.col(died) == "Y", n > m),
        "survived_means_equal": F.when(F.col(died) == "N", n == m),
        "casualties_at_least_excluded": F.col(casualties) >= m,
        "year_is_of_date": F.col(year) == F.year(date),
        "foiled_means_none": F.when(F.col(status) == "F", m == 0),
        "no_manifesto_no_details": F.when(F.col(manifesto) == "N", empty),
    }


def dangling_refs(edges: DataFrame, cases: DataFrame, edge_id: str, ends: list[str], key: str, first_year: int = 2001) -> DataFrame:
    """(edge, end, ref, kind): endpoints without a case, by kind: before the table's first year, placeholder, or dangling."""
    ref = F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).cast("string").alias("ref")) for e in ends])).alias("x")
    rows = edges.select(F.col(edge_id).alias("edge"), ref).select("edge", "x.end", "x.ref").where(F.col("ref").isNotNull())
    lost = rows.join(cases.select(F.col(key).cast("string").alias("ref")), "ref", "left_anti")
    year = F.regexp_extract("ref", r"^[A-Z]{2,4}-(\d{4})-", 1).try_cast("int")
    kind = F.when(F.col("ref").startswith("["), "placeholder").when(year < first_year, "before_table").otherwise("dangling")
    return lost.select("edge", "end", "ref", kind.alias("kind"))


def coverage(df: DataFrame, given: dict[str, Column]) -> DataFrame:
    """(check, n) of named conditions in one pass."""
    sums = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(given.values())])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"c{i}").alias("n")) for i, k in enumerate(given)])).alias("r")).select("r.*")
