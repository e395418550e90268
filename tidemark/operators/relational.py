"""Sampling, ranking, deduplication and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sampling_key


def top_per_key(df: DataFrame, key: str | list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key. Spark limits each task's rows of a key before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def sample_per_key(df: DataFrame, key: str | list[str], id_col: str, n: int | None, seed: int = 42) -> DataFrame:
    """n rows of each key, drawn by a seeded hash of the id; all rows if n is None."""
    if n is None:
        return df
    return top_per_key(df, key, [sampling_key(F.col(id_col), seed), F.col(id_col)], n)


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, drawn by a seeded hash of the id."""
    return df.orderBy(sampling_key(F.col(id_col), seed), id_col).limit(n)


def modular_sample(df: DataFrame, id_col: str, target: int, offset: int = 0, count: int | None = None) -> DataFrame:
    """About `target` rows: those whose id leaves `offset` by count // target."""
    step = max(1, (df.count() if count is None else count) // target)
    return df.where(F.col(id_col) % step == offset % step)


def first_by_precedence(df: DataFrame, keys: list[str], kind: str, precedence: list[str], ties: list[str]) -> DataFrame:
    """One row a key: of the kind that comes first in precedence, then by ties."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col(kind)), F.lit(0))
    rank = F.when(place == 0, len(precedence) + 1).otherwise(place)
    return top_per_key(df, keys, [rank, *[F.col(t) for t in ties]], 1)


def members(df: DataFrame, of: DataFrame, on: str) -> DataFrame:
    """Rows whose key occurs in `of`."""
    return df.join(of.select(on), on, "left_semi")


def thread_neighbours(posts: DataFrame, hits: DataFrame, post: str, thread: str) -> DataFrame:
    """Posts of the threads that hold a hit."""
    threads = posts.join(hits.select(post), post, "left_semi").where(F.col(thread).isNotNull()).select(thread)
    return posts.join(threads, thread, "left_semi")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return counts_by(df, *keys).where("n > 1")


def log_histogram(df: DataFrame, value: str, bins: int = 24, low: float = 0.5, high: float | None = None) -> DataFrame:
    """(bin, n) of equal steps of log10 from low to high (default: the maximum); smaller values count in the first bin."""
    x = F.log10(F.greatest(F.col(value).cast("double"), F.lit(low)))
    top = F.log10(F.lit(float(high))) if high is not None else df.select(F.log10(F.greatest(F.max(value).cast("double"), F.lit(low)))).scalar()
    step = (x - F.log10(F.lit(low))) / (top - F.log10(F.lit(low))) * bins
    return df.where(F.col(value).isNotNull()).select(F.least(F.floor(step).cast("int"), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def value_median(df: DataFrame, value: str) -> DataFrame:
    """(n, median) of the values that are not null; n rows have one."""
    return df.agg(F.count(value).alias("n"), F.median(F.col(value).cast("double")).alias("median"))


def success_rate(df: DataFrame, flag: str) -> DataFrame:
    """(n, n_true, rate): nulls count as false; the rate of no rows is 0."""
    hit = F.count_if(F.coalesce(F.col(flag), F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("n"), hit.alias("n_true")).select("n", "n_true", F.when(F.col("n") > 0, F.col("n_true") / F.col("n")).otherwise(0.0).alias("rate"))


def members_where(df: DataFrame, cases: DataFrame, on: str, condition: Column) -> DataFrame:
    """Rows whose key is that of a case for which the condition holds."""
    return members(df, cases.where(condition), on)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by `order`, so that every run takes the same."""
    return df.orderBy(*order).limit(n)


def spread_by(df: DataFrame, key: str):
    """df grouped by key for work that is heavy for its bytes: adaptive execution, which goes by bytes, would make few tasks of the groups."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).groupBy(key)


def broadcast_if_few(df: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if `rows`, which bounds it, has at most `most` rows; as it is beyond that."""
    return F.broadcast(df) if rows.limit(most + 1).count() <= most else df
