"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where no match of the pattern can cross: between a character that is not white
space and one that is. Every alternative of the pattern ends before white space that follows
something else, and none looks back, so the pieces encode as the whole would. That keeps the
library's regular expression and its memory to pieces of bounded size wherever a text has spaces.

A long run of white space is no work for the expression, whose look-ahead steps back through it:
by the pattern's own rule all of it but the last character, or all of it at the end of a text, is
one match. Its bytes go to the merges directly.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, lean, outer_id, raw_bytes, slices

PIECE = 20_000
#: White space here but not in the library's expression: U+001C to U+001F. No cut is made beside them.
_SAFE = re.compile(r"[^\s\x1c-\x1f](?=[^\S\x1c-\x1f])")
_RUN = re.compile(r"[^\S\x1c-\x1f]{1000,}")


@lru_cache(2)
def encoding(path: str, pattern: str):
    """The encoding of a rank file (base64 token, space, rank on each line), loaded once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in pieces of about `size` characters, cut at safe boundaries only."""
    out, at = [], 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size - 1)
        if not found:
            break
        out.append(text[at : found.end()])
        at = found.end()
    out.append(text[at:])
    return out


def _encoded(enc, piece: str) -> list[np.ndarray]:
    """The ids of a piece; long runs of white space apart from what is around them."""
    parts, at = [], 0
    for run in _RUN.finditer(piece) if len(piece) >= 1000 else ():
        end = run.end() - (run.end() < len(piece))
        parts.append(enc.encode_to_numpy(piece[at : run.start()], disallowed_special=()))
        parts.append(np.array(enc._core_bpe.encode_single_piece(piece[run.start() : end].encode()), np.uint32))
        at = end
    parts.append(enc.encode_to_numpy(piece[at:], disallowed_special=()))
    return parts


def encode_text(enc, text: str) -> np.ndarray:
    parts = [ids for p in pieces(text) for ids in _encoded(enc, p)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _encode(path: str, pattern: str):
    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            flat, at = raw_bytes(batch.column("text"))
            for i, j in slices(at, 2 << 20):
                ids = [encode_text(enc, flat[at[r] : at[r + 1]].tobytes().decode()).astype("<u4").tobytes() for r in range(i, j)]
                yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    return run


def encode(documents: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, unsigned 32-bit little-endian) for every row.

    No special tokens: their strings are ordinary text. Null texts encode as empty. Null and repeated
    ids are kept; other columns are not read; an empty table gives an empty result.
    """
    found = id_text(documents, id_col, text_col).mapInArrow(lean(_encode(ranks, pattern)), "id long, n_tokens long, ids binary")
    return found.select(outer_id().alias(id_col), "n_tokens", "ids")


def _decode(path: str, pattern: str, ids_col: str):
    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            flat, at = raw_bytes(batch.column(ids_col))
            for i, j in slices(at, 4 << 20):
                found = [enc.decode_bytes(np.frombuffer(flat[at[r] : at[r + 1]].tobytes(), "<u4").tolist()) for r in range(i, j)]
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns), pa.array(found, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with column decoded (binary): the raw bytes of their ids, whether or not they are valid UTF-8. Null ids decode as empty."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    rows = encoded.drop("decoded")
    return rows.mapInArrow(lean(_decode(ranks, pattern, ids_col)), StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))
