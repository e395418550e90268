"""Arrow-batched Python functions, where Spark has no built-in one."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


#: Character references that end in a semicolon.
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed_reference(m: re.Match) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0]


@F.pandas_udf(StringType())
def _unescape_closed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _CLOSED.sub(_closed_reference, x), na_action="ignore")


def html_unescape(c: Column, closed: bool = False) -> Column:
    """Character references decoded, closed: only those that end in a semicolon. Texts without one don't leave the JVM."""
    return F.coalesce((_unescape_closed if closed else _unescape)(F.when(c.contains("&"), c)), c)


def nfkc(c: Column) -> Column:
    """Compatibility form. Plain ASCII is its own: such texts don't leave the JVM."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        u = row & at.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """Similarity 0 to 100 by insertions and deletions: 200 * common subsequence / both lengths."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def contained(patterns: list[str]):
    """A function of a text column: the patterns that it contains, by one automaton a worker, which holds one text of a batch at a time."""

    @F.arrow_udf(ArrayType(StringType()))
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for s in batches:
            yield pa.array([sorted({p for _, p in automaton.iter(t)}) if t else [] for t in (x.as_py() for x in s)], pa.list_(pa.string()))

    return find


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts may be long: no more than `rows` of them cross to a worker at once, however many a task has. A setting of the session, as plans read it when they run."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Embedder(Protocol):
    """embed(texts): a vector for each text. Built anew in each worker."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    """score(questions, texts): a logit for each pair. Built anew in each worker."""

    def score(self, questions: list[str], texts: list[str]) -> list[float]: ...


def embedding(build: Callable[[], Embedder], batch: int = 256):
    """A function of a text column: unit vectors of an embedder that each worker builds once, `batch` texts at a time. Null and empty texts have the null vector."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for s in batches:
            out: list = [None] * len(s)
            rows = [k for k, t in enumerate(s) if t]
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                x = np.asarray(model.embed([s.iloc[k] for k in part]), np.float64)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                for k, v in zip(part, x, strict=True):
                    out[k] = v.astype(np.float32).tolist()
            yield pd.Series(out, index=s.index, dtype=object)

    return run


def pair_logit(build: Callable[[], PairScorer], batch: int = 256):
    """A function of a question and a text column: logits of a scorer that each worker builds once, `batch` pairs at a time. Null where either is null."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = build()
        for q, t in batches:
            out = np.full(len(q), np.nan)
            rows = np.flatnonzero((q.notna() & t.notna()).to_numpy())
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                out[part] = model.score(q.iloc[part].tolist(), t.iloc[part].tolist())
            yield pd.Series(out, index=q.index).where(q.notna() & t.notna(), None).astype("float64")

    return run


def batch_rows(memory_bytes: int, row_bytes: int, most: int = 1024) -> int:
    """The largest power of two of rows that fit, 1 to `most`: the batch of a model with so much memory free."""
    fits = max(1, memory_bytes // max(1, row_bytes))
    return min(most, 1 << (int(fits).bit_length() - 1))


def hashed_embedding(dim: int = 64):
    """A function of a text column: a deterministic unit vector of hashed words, for runs without a model."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(s: pd.Series) -> pd.Series:
        import zlib

        def one(text):
            v = np.zeros(dim)
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype("float32").tolist()

        return s.map(one)

    return embed
