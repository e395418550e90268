"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside an operator, so that null sorts first and joins.
NULL_ID = -(2**63)


def release() -> None:
    """Give memory that is free again back to the machine: idle workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """A worker function that releases memory when it is through with a partition or a group."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def each(batches):
            try:
                yield from run(batches)
            finally:
                release()

        return each

    def group(*tables):
        try:
            return run(*tables)
        finally:
            release()

    # Spark looks at the number of parameters
    needed = [p for p in inspect.signature(run).parameters.values() if p.default is p.empty]
    return (lambda left, right: group(left, right)) if len(needed) == 2 else (lambda table: group(table))


def short_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Texts may be long: no more than `rows` of them, or about `size` bytes, cross to a worker at once.

    A setting of the session, as plans read it when they run; it stays for later queries.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < _bytes(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def _bytes(value: str) -> int:
    """A size setting as a number: 64MB is 67108864."""
    number = value.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(number[-1:], 0)
    return int(number[:-1] if unit else number) << unit


_folders: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    On one machine (a local master) a folder of its own is made and set where neither is named; on
    a cluster that is an error, as executors would each write to their own disk.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and continue from there."""
    shared_base(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared folder. What is written there goes when the application ends."""
    application = spark.sparkContext.applicationId
    if application not in _folders:
        _folders[application] = f"{shared_base(spark)}/{application}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders[application])
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return f"{_folders[application]}/{kind}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (id, text), without nulls: other columns can't clash with an operator's own."""
    short_batches(df.sparkSession)
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def whole_row(df: DataFrame):
    """All columns as one, `_row`, so that none clashes with an operator's own; select("_row.*") gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def outer_id(column: str = "id"):
    """The id as the caller knows it: null where it was null."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


def raw_bytes(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column, without a copy per row."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row stands alone."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each row, count long."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def join_spread(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """left joined with right, which has at most one row a key, on `key`; how: inner or left.

    A key of left that holds more than 1/10,000 of its rows, and over 10,000, would fill one task: at
    most 10,000 such keys are found by a count, and their rows of right broadcast. left is
    read three times, so it should be written or cheap.
    """
    n = left.count() if rows is None else rows
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(10_000, n // 10_000)).select(key, F.lit(True).alias("_hot"))
    if n <= 10_000 or hot.isEmpty():
        return left.join(right, key, how)
    flagged = left.join(F.broadcast(hot), key, "left")
    few = right.join(F.broadcast(hot.select(key)), key, "left_semi")
    rest = flagged.where("_hot is null").drop("_hot").join(right, key, how)
    return rest.unionByName(flagged.where("_hot").drop("_hot").join(F.broadcast(few), key, how))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps over edges from the larger node to the smaller until the
    edge set no longer changes. A step needs a node's smallest neighbour, a minimum that is
    combined before the shuffle, and a join with it, which takes hubs apart (join_spread).
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    e = checkpointed(edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        # a node's smallest neighbour, if any is smaller than itself
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        # large star: a node's larger neighbours are tied to its smallest
        large = join_spread(e, least.withColumnRenamed("a", "b"), "b", "left", now[0]).select("a", F.coalesce("m", "b").alias("b"))
        large = checkpointed(large.where("a <> b").distinct())
        # small star: a node's smaller neighbours, and itself, to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = join_spread(large, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(joined.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def even_keys(n: int, each: int = 1) -> np.ndarray:
    """n * each longs of which Spark's hash partitioning deals `each` to every one of n partitions, so that tasks get equally many groups.

    Only the balance rests on it: any n different keys give the same results.
    """
    def turn(x, r):
        return (x << np.uint32(r)) | (x >> np.uint32(32 - r))

    keys = np.arange(max(64, int(n * each * (np.log(n + 1) + 8))), dtype=np.int64)
    h = np.full(len(keys), 42, np.uint32)
    for part in (keys & 0xFFFFFFFF, keys >> 32):  # Murmur3 of a long
        k = turn(part.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    place = np.mod(h.view(np.int32).astype(np.int64), n)
    order = np.argsort(place, kind="stable")
    counts = np.bincount(place, minlength=n)
    rank = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)  # of a key among those of its partition
    found = keys[order][rank < each]
    missing = n * each - len(found)  # left over by bad luck: keys that share a partition
    return np.r_[found, keys[-1] + 1 + np.arange(missing)]


def range_bounds(ids: DataFrame, n: int) -> list[int]:
    """n - 1 ascending bounds that deal the values of column id into n shards of about equal rows.

    One pass over the id column; a value held by many rows appears as several bounds.
    """
    if n < 2:
        return []
    found = ids.agg(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(max(10_000, 20 * n))).alias("p")).first()["p"]
    return sorted(found or [])


def range_shard(ids: np.ndarray, marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shard of each row; shards ascend with (id, mark). marks: hashes, which cut a value that fills several shards."""
    left, right = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    share = (marks.astype(np.float64) + 2.0**63) / 2.0**64
    return np.where(right - left >= 2, left + 1 + np.minimum((share * (right - left)).astype(np.int64), right - left - 1), right)
