"""Token-id files as directly addressable codes.

An id is cut into chunks of `bits` bits, lowest first. Level l holds the l-th chunks of all ids that
have one, one byte each, with a bitmap that tells which of them continue on level l + 1; a rank
directory counts the set bits before each block of 512, so the place of an id's next chunk is one
look-up and a popcount away. Any id is read without decoding those around it.

Files are Parquet tables, written by Spark with its commit protocol so that retried tasks leave
no half file, one row a segment: shard, segment, base (ids of the shard's earlier segments),
n_docs, n_tokens and payload. A payload is little-endian:

  b"DAC1", int64 documents, tokens, levels, bits
  int64 id of each document, int64 start of each document and the end
  for each level: int64 chunks, the chunks (uint8), the bitmap (padded to 64 bytes), the directory (uint32)

Shards ascend with the document id, so the stream of ids in ascending order is the segments in order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_bpe
from .common import even_keys, id_text, lean, outer_id, partitions, range_bounds, range_shard, raw_bytes, slices

MAGIC, BLOCK = b"DAC1", 512
SEGMENT_TOKENS = 8 << 20


class TokenCodes:
    """A payload, addressed in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token payload")
        head = np.frombuffer(payload, "<i8", 4, 4)
        self.n_docs, self.n_tokens, self.bits = int(head[0]), int(head[1]), int(head[3])
        at = 36
        self.doc_ids = np.frombuffer(payload, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(payload, "<i8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(int(head[2])):
            n = int(np.frombuffer(payload, "<i8", 1, at)[0])
            blocks = -(-n // BLOCK)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            bitmap = np.frombuffer(payload, np.uint8, blocks * BLOCK // 8, at + 8 + n)
            ranks = np.frombuffer(payload, "<u4", blocks, at + 8 + n + len(bitmap))
            self.levels.append((chunks, bitmap, ranks))
            at += 8 + n + len(bitmap) + 4 * blocks

    @staticmethod
    def build(doc_ids: np.ndarray, starts: np.ndarray, tokens: np.ndarray, bits: int = 8) -> bytes:
        if not 1 <= bits <= 8:
            raise ValueError("a chunk has 1 to 8 bits")
        levels, rest = [], tokens.astype(np.uint32)
        while True:
            more = rest >> np.uint32(bits)
            on = more > 0
            padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
            padded[: len(on)] = on
            counts = padded.reshape(-1, BLOCK).sum(axis=1)
            levels.append(b"".join([np.array([len(rest)], "<i8").tobytes(), (rest & np.uint32((1 << bits) - 1)).astype(np.uint8).tobytes(), np.packbits(padded, bitorder="little").tobytes(), (np.cumsum(counts) - counts).astype("<u4").tobytes()]))
            rest = more[on]
            if not len(rest):
                break
        head = np.array([len(doc_ids), len(tokens), len(levels), bits], "<i8")
        return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), *levels])

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i."""
        _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        if block == len(ranks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        bits = np.unpackbits(bitmap[block * BLOCK // 8 : i // 8 + 1], bitorder="little")[: i - block * BLOCK]
        return int(ranks[block]) + int(bits.sum())

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out, level = 0, 0
        while True:
            chunks, bitmap, _ = self.levels[level]
            out |= int(chunks[i]) << (self.bits * level)
            if not bitmap[i // 8] >> (i % 8) & 1:
                return out
            i, level = self._rank(level, i), level + 1

    def tokens(self, start: int, end: int) -> np.ndarray:
        """ids[start:end], from those places of each level alone."""
        out, rows, lo, hi = np.zeros(end - start, np.uint32), np.arange(end - start), start, end
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if lo == hi:
                break
            out[rows] |= chunks[lo:hi].astype(np.uint32) << np.uint32(self.bits * level)
            on = np.unpackbits(bitmap[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            first = self._rank(level, lo)
            rows, lo, hi = rows[on], first, first + int(on.sum())
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def _encoded(path: str, end_id: int | None, bounds: np.ndarray, keys: np.ndarray):
    def run(batches):
        model = word_bpe.load(path)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            flat, at = raw_bytes(batch.column("text"))
            for i, j in slices(at, 4 << 20):
                raw = [flat[at[r] : at[r + 1]].tobytes() for r in range(i, j)]
                ids = batch.column("id")[i:j].to_numpy(zero_copy_only=False)
                marks = np.array([xxhash.xxh64_intdigest(t) - 2**63 for t in raw], np.int64)
                found = model.ids([t.decode() for t in raw])
                kind = [np.uint16 if not len(x) or x.max() < 65536 else np.uint32 for x in found]
                packed = [np.concatenate([x, end]).astype(k).tobytes() for x, k in zip(found, kind, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[range_shard(ids, marks, bounds)], pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array([k().itemsize for k in kind], pa.int32()), pa.array(packed, pa.binary())],
                    names=["slot", "id", "mark", "width", "tokens"],
                )

    return run


_SEGMENTS = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("base", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


def _segments(bits: int, keys: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        shard = int(np.flatnonzero(keys == table.column("slot")[0].as_py())[0])
        ids, marks = table.column("id").to_numpy(), table.column("mark").to_numpy()
        order = np.lexsort((marks, ids))
        widths, packed = table.column("width").to_pylist(), table.column("tokens")
        rows, held, base = [], [], 0

        def close():
            nonlocal held, base
            if held:
                tokens = np.concatenate([t for _, t in held])
                starts = np.cumsum([0, *(len(t) for _, t in held)])
                rows.append((shard, len(rows), base, len(held), len(tokens), TokenCodes.build(np.array([i for i, _ in held], np.int64), starts, tokens, bits)))
                base += len(tokens)
                held = []

        size = 0
        for r in order.tolist():
            t = np.frombuffer(packed[r].as_py(), np.uint16 if widths[r] == 2 else np.uint32)
            if size + len(t) > SEGMENT_TOKENS:
                close()
                size = 0
            held.append((ids[r], t))
            size += len(t)
        close()
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [()] * 6, _SEGMENTS, strict=True)], schema=_SEGMENTS)

    return run


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text with the tokenizer file and write the ids, in ascending id order, to folder.

    A null text counts as empty: it gives the end id alone. A null id sorts first. Rows that repeat
    an id stand side by side, ordered by a hash of their text. An empty table writes an empty table.
    """
    x = id_text(documents, id_col, text_col)
    n = partitions(documents.sparkSession)
    bounds, keys = np.array(range_bounds(x, 4 * n), np.int64), even_keys(n, 4)  # a task holds one shard at a time, four in all
    encoded = x.mapInArrow(lean(_encoded(tokenizer, end_id, bounds, keys)), "slot long, id long, mark long, width int, tokens binary")
    encoded.groupBy("slot").applyInArrow(lean(_segments(bits, keys)), "shard long, segment long, base long, n_docs long, n_tokens long, payload binary").write.mode("overwrite").option("compression", "none").parquet(folder)


def _documents(before: dict[int, int]):
    def run(batches):
        for batch in batches:
            for shard, base, payload in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), batch.column("payload"), strict=True):
                codes = TokenCodes(payload.as_py())
                for i in range(0, codes.n_docs, 500):
                    ks = range(i, min(i + 500, codes.n_docs))
                    first = int(codes.starts[i])
                    part = codes.tokens(first, int(codes.starts[ks.stop])).astype("<u4")
                    ids = [part[codes.starts[k] - first : codes.starts[k + 1] - first].tobytes() for k in ks]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(codes.doc_ids[i : ks.stop]), pa.array(codes.starts[i : ks.stop] + base + before[shard]), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                        names=["id", "start", "n_tokens", "token_ids", "ids_crc32"],
                    )

    return run


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: id, start (ids before it), n_tokens, token_ids (uint32, little-endian), ids_crc32.

    The driver gathers one sum for each shard, of which there are four times as many as shuffle partitions.
    """
    files = spark.read.schema("shard long, segment long, base long, n_docs long, n_tokens long, payload binary").parquet(folder)
    before, total = {}, 0
    for row in files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        before[row.shard], total = total, total + row.n
    found = files.select("shard", "base", "payload").mapInArrow(lean(_documents(before)), "id long, start long, n_tokens long, token_ids binary, ids_crc32 long")
    return found.select(outer_id().alias(id_col), "start", "n_tokens", "token_ids", "ids_crc32")
