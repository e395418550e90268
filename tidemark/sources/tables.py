"""Readers and writers: post archives, delimited files, partitioned Parquet, Markdown records, manifests."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import subprocess
import tarfile
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T
from ..functions.scalars import lenient_int, lenient_string
from ..session import scratch_folder

#: Places of the fields in a 28-column post file.
POST_COLUMNS = {"post_id": 0, "thread_id": 2, "timestamp": 4, "image": 14, "title": 21, "comment": 22, "poster_id": 25, "country_code": 26}
POST_WIDTH = 28


def _csv_member(archive: tarfile.TarFile) -> tarfile.TarInfo:
    for m in archive:
        if m.isfile() and m.name.endswith(".csv") and not m.name.startswith("/") and ".." not in Path(m.name).parts:
            return m
    raise FileNotFoundError("the archive holds no CSV file")


def archive_rows(path: str, chunk: int = 100_000) -> Iterator[list[list[str]]]:
    """Chunks of rows of the first CSV in a tar.gz, decoded with replacement of bad bytes."""
    with tarfile.open(path, "r:*") as archive:
        raw = archive.extractfile(_csv_member(archive))
        rows: list[list[str]] = []
        for row in csv.reader(io.TextIOWrapper(raw, "utf-8", errors="replace", newline="")):
            rows.append(row)
            if len(rows) == chunk:
                yield rows
                rows = []
        if rows:
            yield rows


class _ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], width: int):
        self.paths, self.width = paths, width

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        for rows in archive_rows(partition.value):
            for row in rows:
                yield (*((row + [None] * self.width)[: self.width]), len(row))


class ArchiveSource(DataSource):
    """spark.read.format("tar_csv").option("paths", "a.tar.gz,b.tar.gz").load(): strings c0, c1, ... and n_fields. A task an archive, as gzip can't be split."""

    @classmethod
    def name(cls):
        return "tar_csv"

    def schema(self):
        return ", ".join(f"c{i} string" for i in range(int(self.options.get("width", POST_WIDTH)))) + ", n_fields int"

    def reader(self, schema):
        return _ArchiveReader(self.options["paths"].split(","), int(self.options.get("width", POST_WIDTH)))


def read_archives(spark: SparkSession, paths: list[str], width: int = POST_WIDTH) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tar_csv").option("paths", ",".join(paths)).option("width", str(width)).load()


def first_row(df: DataFrame) -> list:
    row = df.first()
    return [] if row is None else list(row)


def parse_posts(rows: DataFrame, board: str, year_min: int = 2013, year_max: int = 2025, limit: int | None = None) -> DataFrame:
    """Posts from raw rows of 23 fields or more with a post id and a time within the years."""
    at = {k: F.col(f"c{i}") for k, i in POST_COLUMNS.items()}
    raw = F.coalesce(F.when(at["comment"] != "\\N", at["comment"]), F.lit(""))
    x = rows.where("n_fields >= 23").select(lenient_int(at["post_id"]).alias("post_id"), lenient_int(at["thread_id"]).alias("thread_id"), F.lit(board).alias("board"), F.timestamp_seconds(lenient_int(at["timestamp"])).alias("timestamp_utc"), *[lenient_string(at[c]).alias(c) for c in ("poster_id", "country_code", "title")], T.strip_html(raw).alias("body"), T.reply_ids(raw).alias("reply_to"), lenient_string(at["image"]).isNotNull().alias("has_image"))
    x = x.where(F.col("post_id").isNotNull() & F.year("timestamp_utc").between(year_min, year_max))
    x = x.select("post_id", "thread_id", "board", "timestamp_utc", "poster_id", "country_code", "title", "body", T.clean_body(F.col("body")).alias("body_clean"), "reply_to", "has_image", F.year("timestamp_utc").alias("year"), F.month("timestamp_utc").alias("month"))
    return x if limit is None else x.limit(limit)


def read_csv(spark: SparkSession, path: str, infer: bool = False, header: bool = True, schema: str | None = None) -> DataFrame:
    """Quoted fields may hold line ends and doubled quotes. All strings unless infer or a schema is given."""
    reader = spark.read.options(header=header, multiLine=True, quote='"', escape='"', inferSchema=infer and schema is None, mode="PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Lazy; key=value folders become columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_partitioned(df: DataFrame, path: str, keys: list[str], append: bool = False) -> int:
    """Folders by key; returns how many keys the table has then. Rows of a key are spread over tasks, so that a hot key is not one task's work."""
    df.hint("rebalance", *keys).write.mode("append" if append else "overwrite").option("compression", "zstd").partitionBy(*keys).parquet(path)
    return df.sparkSession.read.parquet(path).select(*keys).distinct().count()  # of folder names: no column is read


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def replace_table(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones and return its folder: a plan may still read the version before."""
    folder = f"{path.rstrip('/')}/version={int(time.time() * 1e6)}"
    df.write.option("compression", "zstd").parquet(folder)
    return folder


LINES = 50_000  # lines of a file that are sorted at once


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, text), lines from 0. Files are read in splits and numbered by the rows before each split.

    The read lines are kept in the scratch folder: a second read might be split elsewhere.
    """
    path = scratch_folder(spark, "lines")
    read = spark.read.option("lineSep", "\n").text(paths)
    read.select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), "value").write.parquet(path)
    kept = spark.read.parquet(path)
    # a row a split, whose places follow one another
    splits = kept.groupBy("file", "split").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", (before - F.col("first")).alias("shift"))
    return kept.join(F.broadcast(starts), ["file", "split"]).select("file", (F.col("place") + F.col("shift")).cast("int").alias("line"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("text"))


def _filled(lines: DataFrame, header) -> DataFrame:
    """Each line with the last header up to it: within LINES lines, then from the parts of the file before."""
    held = lines.select("*", header.alias("_own"), F.floor(F.col("line") / LINES).alias("_part"))
    order = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = held.groupBy("file", "_part").agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("line"))).alias("_last"))
    lasts = lasts.select("file", "_part", F.last("_last", ignorenulls=True).over(order).alias("_before"))
    here = F.last("_own", ignorenulls=True).over(Window.partitionBy("file", "_part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("_here", here).join(F.broadcast(lasts), ["file", "_part"]).withColumn("header", F.coalesce("_here", "_before")).drop("_own", "_part", "_here", "_before")


def markdown_records(spark: SparkSession, paths: str | list[str], key: str = r"^(?:[A-Z]{2,4}-\d{4}-|NET-)") -> DataFrame:
    """(file, ordinal, record, fields): `### ID` opens a record if ID fits key, `- name: value` lines are its fields, the last of a name counts."""
    name = F.regexp_extract("text", r"^###\s+(.+?)\s*$", 1)
    lines = _filled(_lines(spark, paths), F.when(name.rlike(key), F.struct(F.col("line").alias("at"), name.alias("id"))).when(F.col("text").startswith("### "), F.struct(F.lit(-1).alias("at"), F.lit("").alias("id"))))
    field = lines.where("header.at >= 0").select("file", F.col("header.at").alias("ordinal"), F.col("header.id").alias("record"), "line", F.regexp_extract("text", r"^-\s+([A-Za-z0-9_]+):\s*(.*)$", 1).alias("k"), F.trim(F.regexp_extract("text", r"^-\s+([A-Za-z0-9_]+):\s*(.*)$", 2)).alias("v"))
    last = field.groupBy("file", "ordinal", "record", "k").agg(F.max_by("v", "line").alias("v"))
    return last.groupBy("file", "ordinal", "record").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("k", "v")), lambda x: x["k"] != "")).alias("fields"))


def markdown_table(spark: SparkSession, path: str, start: str = "| #", least: int = 4) -> DataFrame:
    """(line, cells) of the table whose header row starts with `start`, up to the first line that is no row."""
    lines = _lines(spark, path)
    head = lines.where(F.col("text").startswith(start)).groupBy("file").agg(F.min("line").alias("first"))
    after = lines.join(F.broadcast(head), "file").where("line > first")
    stop = after.where(~F.col("text").startswith("|")).groupBy("file").agg(F.min("line").alias("stop"))
    rows = after.join(F.broadcast(stop), "file", "left").where("stop is null or line < stop").where(~F.col("text").rlike(r"^[|\s:\-]+$"))
    cells = F.filter(F.transform(F.split("text", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("line", cells.alias("cells")).where(F.size("cells") >= least)


def markdown_sections(spark: SparkSession, path: str, categories: dict[str, str], item: str = r"^-\s+`?([A-Z]{2,4}-\d{4}-[A-Z0-9_\-]+)`?") -> DataFrame:
    """(category, item): bullets below the header that holds a category's name, or is held by it."""
    lines = _filled(_lines(spark, path), F.when(F.col("text").startswith("###"), F.lower(F.trim(F.regexp_replace("text", "^#+", "")))))
    kind = F.lit(None).cast("string")
    for name, value in reversed(list(categories.items())):
        low = F.lit(name.lower())
        kind = F.when(F.col("header").contains(low) | low.contains(F.col("header")), F.lit(value)).otherwise(kind)
    found = lines.where(F.col("header").isNotNull() & (F.col("header") != "")).select("line", kind.alias("category"), F.regexp_extract("text", item, 1).alias("item"))
    return found.where("item <> '' and category is not null").select("category", "item")


def corpus_manifest(posts: DataFrame, time_col: str = "timestamp_utc", thread: str = "thread_id", body: str = "body") -> DataFrame:
    """(year, month, n_posts, n_threads, mean_bytes)."""
    return posts.groupBy(F.year(time_col).alias("year"), F.month(time_col).alias("month")).agg(F.count(F.lit(1)).alias("n_posts"), F.count_distinct(thread).alias("n_threads"), F.round(F.avg(F.octet_length(body)), 1).alias("mean_bytes"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file, hashed where it is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest_record(posts: DataFrame, path: str, out: str | None = None, **columns) -> dict:
    """The manifest of a stored corpus: rows a month, their total, and each file's length and SHA-256; written as JSON to `out`, a local path, if given."""
    months = [r.asDict() for r in corpus_manifest(posts, **columns).orderBy("year", "month").collect()]  # a row a month
    files = [r.asDict() for r in file_hashes(posts.sparkSession, path).orderBy("path").collect()]  # a row a file
    record = {"months": months, "total": sum(m["n_posts"] for m in months), "files": files}
    if out:
        Path(out).parent.mkdir(parents=True, exist_ok=True)
        Path(out).write_text(json.dumps(record, indent=1, default=str))
    return record


class RunLog:
    """A JSON record of one run: settings, inputs, outputs, duration, figures, revision."""

    def __init__(self, name: str, settings: object = None):
        self.record = {"name": name, "settings": getattr(settings, "__dict__", {}), "inputs": {}, "outputs": {}, "metrics": {}, "started": time.time(), "revision": self._revision()}

    @staticmethod
    def _revision() -> str:
        try:
            return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5).stdout.strip()
        except OSError:
            return ""

    def add(self, kind: str, path: str, spark: SparkSession | None = None) -> None:
        """Note a file or folder by one SHA-256 over its files'; with a session they are hashed where they are read."""
        p = Path(path)
        if spark is not None:
            each = [r["sha256"] for r in file_hashes(spark, path).orderBy("path").collect()]  # a row a file
        else:
            each = []
            for f in [p] if p.is_file() else sorted(x for x in p.rglob("*") if x.is_file()):
                with f.open("rb") as opened:
                    each.append(hashlib.file_digest(opened, "sha256").hexdigest())
        self.record[kind][str(path)] = each[0] if len(each) == 1 else hashlib.sha256("".join(each).encode()).hexdigest()

    def metric(self, name: str, value) -> None:
        self.record["metrics"][name] = value

    def write(self, path: str) -> None:
        self.record["seconds"] = time.time() - self.record["started"]
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.record, indent=1, default=str))
