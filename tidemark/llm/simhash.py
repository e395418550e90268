"""Near-duplicate groups by SimHash, with candidates from Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the
perfect binary Golay code [23, 12, 7]: every 23-bit word lies within 3 bits of exactly one of
4096 codewords. A segment's own key is the index of its codeword; its near keys are the indices
of the codewords of all words within one bit of it, one to six.

With at most 3 differing bits over three segments, some two segments differ by at most one bit
each (otherwise two segments would differ by two or more). For that pair, one fingerprint's near
key of the first segment equals the other's own key, and the reverse holds for the second
segment. So joining (near, own) keys of one side with (own, near) keys of the other finds every
link; each candidate is verified by counting bits. The join meets in packed buckets of keys.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, checkpointed, connected_components, even_keys, id_text, join_spread, lean, outer_id, partitions, raw_bytes, slices, spread, whole_row

SEED = 42
MANY = 4096  # pairs of one key beyond which its fingerprints are linked as stars
PIECE = 4 << 20  # bytes of a text at once
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    out = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        out ^= np.where(out >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0)).astype(np.uint32)
    return out


@lru_cache(1)
def _errors() -> np.ndarray:
    """Syndrome -> the only error of at most 3 bits that has it."""
    patterns = np.array([sum(1 << b for b in c) for w in range(4) for c in combinations(range(23), w)], np.uint32)
    table = np.zeros(2048, np.uint32)
    table[_syndrome(patterns)] = patterns
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """Index, 0 to 4095, of the codeword within 3 bits of each 23-bit word."""
    words = words.astype(np.uint32)
    return (words ^ _errors()[_syndrome(words)]) >> np.uint32(11)


def segments(fingerprints: np.ndarray) -> list[np.ndarray]:
    x = fingerprints.view(np.uint64)
    return [(x >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]


def near_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): distinct codeword indices of all words within one bit of each word."""
    flips = np.array([0] + [1 << b for b in range(23)], np.uint32)
    found = np.sort(decode((words[:, None] ^ flips[None, :]).reshape(-1)).reshape(len(words), 24), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, column = np.nonzero(new)
    return row, found[row, column]


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, side, key): a link within 3 bits shares a key between side 0 of one and side 1 of the other, both ways."""
    rows, sides, keys = [], [], []
    parts = segments(fingerprints)
    own, near = [decode(p).astype(np.int64) for p in parts], [near_keys(p) for p in parts]
    for number, (i, j) in enumerate(PAIRS):
        for side, (many, one) in enumerate(((i, j), (j, i))):
            row, index = near[many]
            first, second = (index.astype(np.int64), own[one][row]) if side == 0 else (own[one][row], index.astype(np.int64))
            rows.append(row)
            sides.append(np.full(len(row), side))
            keys.append(number << 24 | first << 12 | second)
    return np.concatenate(rows), np.concatenate(sides), np.concatenate(keys)


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """XXH64 of each run of `width` words; the whole sequence if shorter, nothing if empty."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-width]].tolist()
    hash_ = xxhash.xxh64_intdigest
    return np.array([hash_(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return counts


def simhash(text: bytes, width: int = 3) -> int:
    """Bit i is set if it is set in over half of the hashes of a text's shingles. A long text is read in pieces."""
    counts, total, held, at = np.zeros(64, np.int64), 0, b"", 0
    while at < len(text):
        to = len(text)
        if to - at > PIECE and (space := _SPACE.search(text, at + PIECE)):
            to = space.start()
        piece = held + b" " + text[at:to] if held else text[at:to]
        at = to
        if at < len(text):
            words = piece.rsplit(None, width - 1)[-(width - 1) :] if width > 1 else []
            if len(piece.split(None, width)) < width:  # too few words yet
                held = piece
                continue
            held = b" ".join(words)
        elif held and total and len(piece.split(None, width)) < width:
            break  # nothing new after the last whole piece
        hashes = shingle_hashes(piece, width)
        counts += _bits(hashes)
        total += len(hashes)
    return int((1 << np.flatnonzero(2 * counts > total).astype(object)).sum())


def _fingerprints(batches):
    for batch in batches:
        flat, at = raw_bytes(batch.column("text"))
        for i, j in slices(at, 8 << 20):
            found = np.array([simhash(flat[at[r] : at[r + 1]].tobytes()) for r in range(i, j)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], *([batch.column("mark")[i:j]] if "mark" in batch.schema.names else []), pa.array(found.view(np.int64))], names=["id", *(["mark"] if "mark" in batch.schema.names else []), "fp"])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _keys(keys: np.ndarray):
    """Packed (fingerprint, key and side) by buckets of keys, which `keys` deals evenly."""

    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            prints = np.concatenate(held)
            row, side, key = fuzzy_keys(prints)
            bucket = (_mixed(key.astype(np.uint64)) % np.uint64(len(keys))).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(len(keys) + 1))
            packs = [np.concatenate([prints[row[part]], key[part] << 1 | side[part]]).tobytes() for part in (order[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True))]
            some = [k for k, x in enumerate(packs) if x]
            return pa.RecordBatch.from_arrays([pa.array(keys[some], pa.int64()), pa.array([packs[k] for k in some], pa.binary())], names=["bucket", "pack"])

        for batch in batches:
            held.append(batch.column("fp").to_numpy())
            if sum(map(len, held)) >= 20_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return run


def _linked(most: int):
    """The links among the fingerprints of a bucket's keys."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table.column("pack").to_pylist()]
        prints, key = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((prints, key))
        prints, key = prints[order], key[order]  # keys ascend with the side last: a key's side 0, then its side 1
        start = np.flatnonzero(np.r_[True, key[1:] >> 1 != key[:-1] >> 1])
        size = np.diff(np.r_[start, len(key)])
        ones = np.add.reduceat(key & 1, start)
        zeros = size - ones
        found = [np.zeros((0, 2), np.int64)]
        few = np.flatnonzero((zeros > 0) & (ones > 0) & (zeros * ones <= MANY))
        # pairs of either side, some millions at once
        at, ends = 0, np.cumsum((zeros * ones)[few])
        while at < len(few):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000, "right")))
            own = few[at:to]
            left = spread(start[own], zeros[own])
            times = np.repeat(ones[own], zeros[own])
            right = spread(np.repeat(start[own] + zeros[own], zeros[own]), times)
            found.append(_near(prints[np.repeat(left, times)], prints[right], most))
            at = to
        for g in np.flatnonzero((zeros > 0) & (ones > 0) & (zeros * ones > MANY)):
            found.append(_stars(np.unique(prints[start[g] : start[g] + size[g]]), most))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The pairs (smaller, greater) that differ in 1 to `most` bits."""
    bits = np.bitwise_count((a ^ b).view(np.uint64))
    keep = (bits > 0) & (bits <= most)
    return np.unique(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]], 1), axis=0)


def _stars(prints: np.ndarray, most: int) -> np.ndarray:
    """The connected parts of many different fingerprints: a link from each member to the smallest, in place of all pairs."""
    out, rest = [np.zeros((0, 2), np.int64)], prints
    while len(rest):
        todo, members, rest = [rest[0]], [rest[:1]], rest[1:]
        while todo and len(rest):
            near = np.bitwise_count((rest ^ todo.pop()).view(np.uint64)) <= most
            members.append(rest[near])
            todo += members[-1].tolist()
            rest = rest[~near]
        part = np.concatenate(members)
        if len(part) > 1:
            out.append(np.stack([np.full(len(part) - 1, part.min()), np.delete(part, part.argmin())], 1))
    return np.concatenate(out)


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, fp) for every row, null texts as empty; mark: a hash of the text, which tells rows of one id apart."""
    x = id_text(documents, id_col, text_col)
    return x.withColumn("mark", F.xxhash64("text")).mapInArrow(lean(_fingerprints), "id long, mark long, fp long")


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """(a, b), a < b: links among the distinct fingerprints in column fp that differ in 1 to `most` bits, `most` up to 3.

    All such pairs, but for keys that very many different fingerprints share: there each connected part is a star
    around its smallest, so rows stay in proportion to fingerprints, and who is connected with whom is the same.
    """
    if not 0 <= most <= 3:
        raise ValueError("the Golay keys cover up to 3 differing bits")
    keys = even_keys(partitions(prints.sparkSession), 4)
    packed = prints.select("fp").distinct().mapInArrow(lean(_keys(keys)), "bucket long, pack binary")
    return packed.groupBy("bucket").applyInArrow(lean(_linked(most)), "a long, b long").distinct()


def _grouped(documents: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, mark, fp, least): each row's fingerprint, and the smallest id of its group."""
    prints = checkpointed(fingerprints(documents, id_col, text_col))
    found = connected_components(links(prints, most))
    least = prints.groupBy("fp").agg(F.min("id").alias("first"))
    classes = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    classes = checkpointed(classes)
    ids = classes.groupBy("component").agg(F.min("first").alias("least"))
    named = join_spread(classes, ids, "component").select("fp", "least")
    return join_spread(prints, named, "fp").select("id", "mark", "fp", "least")


def near_duplicate_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Documents with one fingerprint are one node, so exact copies cost one row each and no pairs.
    Null and empty texts have fingerprint zero and are linked like any other. A null id is kept; as
    it sorts first, it is the (null) component id of its group. Equal rows get equal results; other
    columns are not read; an empty table gives an empty result. Ids are whole numbers.
    """
    return _grouped(documents, id_col, text_col, most).select(
        outer_id().alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), outer_id("least").alias("component_id")
    )


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the first of their group, with all their columns.

    Of rows with the group's smallest id, all are kept: they are one document. An id may be held by different
    texts, which are judged each in its own group. Rows with a null id are kept, as nothing tells them apart from others.
    """
    gone = _grouped(documents, id_col, text_col, 3).where(f"id <> least and id <> {NULL_ID}").select(F.col("id").alias("_one_id"), F.col("mark").alias("_one_mark")).distinct()
    keyed = documents.select(whole_row(documents), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_one_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_one_mark"))
    return keyed.join(gone, ["_one_id", "_one_mark"], "left_anti").select("_row.*")
