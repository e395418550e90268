"""Document fingerprints by a randomised edit embedding.

A walk reads a string of characters and writes one character a step: at step j it writes the
character x[i] it stands on and moves on by a random bit that depends on (j, x[i]) alone. All
strings share the bits, so after an insertion or deletion two walks soon read in step again, and
the edit distance of two strings becomes a Hamming distance of what is written.

Walks restart at content-defined places, so a fingerprint's cost is linear, its walks run side by
side, and a change moves only its own surroundings. The written characters are sampled at shared
steps; a sample is named by (characters that open its segment, step). Each of `cells` cells of the
fingerprint keeps, of the samples whose name falls to it, the one with the least name, as two hex
digits of (name, character): equal shares of equal cells estimate how much of two texts agrees.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import NULL_ID, checkpointed, connected_components, even_keys, id_text, join_spread, lean, outer_id, partitions, range_bounds, range_shard, raw_bytes, shared_folder, slices

CELLS, LONGEST, MEAN, OPENING, EVERY = 64, 256, 32, 6, 8
PIECE = 1 << 20  # characters at once
NONE = np.uint64(2**64 - 1)
EMPTY = ".."


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(1)
def _shared() -> tuple[np.ndarray, np.ndarray]:
    """(bit of each step and character class, whether each step is sampled)."""
    steps = np.arange(3 * LONGEST, dtype=np.uint64)
    bits = _mix(steps[:, None] * np.uint64(4099) + np.arange(1024, dtype=np.uint64)[None, :] + np.uint64(7)) & np.uint64(1)
    return bits.astype(np.int32), _mix(steps + np.uint64(1 << 40)) % np.uint64(EVERY) == 0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _cut_after(code: np.ndarray) -> np.ndarray:
    """Whether a segment ends after each three characters."""
    h = _mix(code[:-2] * np.uint64(0x10001) ^ code[1:-1] * np.uint64(0x1F123BB5) ^ code[2:] * np.uint64(0x9E3779B97F4A7C15))
    return h % np.uint64(MEAN) == 0


def _within_longest(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of segments between edges; a long one is cut at fixed distances from its start."""
    parts = -(-np.diff(edges) // LONGEST)
    index = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(edges[:-1], parts) + index * LONGEST
    return start, np.minimum(start + LONGEST, np.repeat(edges[1:], parts))


def _segments(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the segments of texts laid end to end."""
    n = len(code)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        cut[3:] = _cut_after(code)
    for k in (1, 2):  # the three characters before a cut are of one text
        cut[np.minimum(offsets + k, n)] = False
    cut[offsets] = True
    start, end = _within_longest(np.flatnonzero(cut))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _samples(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, step, character) at the sampled steps of each segment's walk."""
    bits, sampled = _shared()
    kind = np.r_[_mix(code) & np.uint64(1023), np.zeros(8, np.uint64)].astype(np.int32)
    lane, at, stop = np.arange(len(start)), start.astype(np.int64), end
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    for j in range(3 * LONGEST):
        if j % 8 == 0:
            alive = at < stop
            lane, at, stop = lane[alive], at[alive], stop[alive]
            if not len(lane):
                break
        if sampled[j]:
            on = at < stop
            out.append((lane[on], j, code[at[on]]))
        at = at + bits[j][kind[at]]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _, _ in out]), np.repeat([j for _, j, _ in out], [len(a) for a, _, _ in out]), np.concatenate([c for _, _, c in out])


def _least(code: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, opens: np.ndarray, texts: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, character) of the least name of each text's cells, the greatest number where there is none. opens: segments that begin their text."""
    opening = np.zeros(len(start), np.uint64)
    for k in range(OPENING):
        here = start + k < end
        opening[here] = _mix(opening[here] * np.uint64(0x100000001B3) + code[start[here] + k] + np.uint64(1))
    opening[opens] = 0  # the opening of a text is named by its place
    lane, step, character = _samples(code, start, end)
    begins = np.flatnonzero(opens)  # their first step is always sampled, so that no text with characters goes without
    lane, step, character = np.r_[lane, begins], np.r_[step, np.zeros(len(begins), np.int64)], np.r_[character, code[start[begins]]]
    name = _mix(opening[lane] + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key = text[lane] * cells + (name % np.uint64(cells)).astype(np.int64)
    order = np.lexsort((character, name, key))
    first = order[np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])] if len(order) else order
    names, characters = np.full(texts * cells, NONE), np.full(texts * cells, NONE)
    names[key[first]], characters[key[first]] = name[first], character[first]
    return names, characters


def _long_least(text: str, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """_least of one long text, whose characters are never all at hand as numbers."""
    cuts = [np.zeros(1, np.int64)]
    for at in range(0, len(text), PIECE):
        code = _codes(text[max(0, at - 2) : at + PIECE])
        if len(code) > 2:
            cuts.append(np.flatnonzero(_cut_after(code)) + max(0, at - 2) + 3)
    edges = np.unique(np.r_[np.concatenate(cuts), len(text)])
    start, end = _within_longest(edges)
    best = np.full(cells, NONE), np.full(cells, NONE)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, "right")))
        code = _codes(text[start[at] : end[to - 1]])
        low = start[at]
        new = _least(code, start[at:to] - low, end[at:to] - low, np.zeros(to - at, np.int64), start[at:to] == 0, 1, cells)
        less = (new[0] < best[0]) | ((new[0] == best[0]) & (new[1] < best[1]))
        best = np.where(less, new[0], best[0]), np.where(less, new[1], best[1])
        at = to
    return best


def fingerprints(texts: list[str], cells: int = CELLS) -> list[str]:
    """A fingerprint of 2 * cells characters for each text; `..` stands for a cell without samples. A long text is read in pieces."""
    names, characters = np.full((len(texts), cells), NONE), np.full((len(texts), cells), NONE)
    sizes = np.cumsum([0, *(len(t) for t in texts)])
    for i, j in slices(sizes, PIECE):
        if j == i + 1 and len(texts[i]) > PIECE:
            names[i], characters[i] = _long_least(texts[i], cells)
            continue
        code = _codes("".join(texts[i:j]))
        if not len(code):
            continue
        offsets = sizes[i : j + 1] - sizes[i]
        start, end, text = _segments(code, np.unique(offsets))
        text = np.flatnonzero(np.diff(offsets) > 0)[text]  # texts with characters, as _segments counts them
        found = _least(code, start, end, text, start == offsets[:-1][text], j - i, cells)
        names[i:j], characters[i:j] = (x.reshape(j - i, cells) for x in found)
    value = _mix(names ^ characters * np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(255)
    return ["".join(EMPTY if e else f"{c:02x}" for c, e in zip(row, empty, strict=True)) for row, empty in zip(value.tolist(), (names == NONE).tolist(), strict=True)]


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of two texts that agrees, from their fingerprints. Two empty texts are equal."""
    if a == b:
        return 1.0
    pairs = [(a[i : i + 2], b[i : i + 2]) for i in range(0, len(a), 2)]
    filled = [(x, y) for x, y in pairs if x != EMPTY or y != EMPTY]
    equal = sum(x == y for x, y in filled) / max(1, len(filled))
    return 2 * equal / (1 + equal)


def edited(text: str, following: str) -> str:
    """The last half of a text's characters replaced by as many of the following text's first (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROUTED = "shard long, tail boolean, id long, mark long, packed binary"


def _mark(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def _places(bounds: np.ndarray):
    def run(batches):
        for batch in batches:
            flat, at = raw_bytes(batch.column("text"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            marks = np.array([_mark(flat[at[r] : at[r + 1]].tobytes()) for r in range(len(ids))], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range_shard(ids, marks, bounds), pa.int64()), pa.array(ids, pa.int64()), pa.array(marks)], names=["shard", "id", "mark"])

    return run


def _route(bounds: np.ndarray, firsts: dict[int, tuple[int, int]], keys: np.ndarray):
    """Rows to their shard, by its key; the first row of a shard also to the shard before, as its tail."""
    order = sorted(firsts)
    before = {s: order[k - 1] for k, s in enumerate(order)}

    def run(batches):
        press, sent = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            flat, at = raw_bytes(batch.column("text"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for i, j in slices(at, 8 << 20):
                texts = [flat[at[r] : at[r + 1]].tobytes() for r in range(i, j)]
                marks = np.array([_mark(t) for t in texts], np.int64)
                rows = []
                for s, id_, mark, text in zip(range_shard(ids[i:j], marks, bounds).tolist(), ids[i:j].tolist(), marks.tolist(), texts, strict=True):
                    z = press.compress(text)
                    rows.append((int(keys[s]), False, id_, mark, z))
                    if (id_, mark) == firsts[s] and s not in sent:
                        sent.add(s)  # its copies need not go too
                        rows.append((int(keys[before[s]]), True, id_, mark, z))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "tail", "id", "mark", "packed"])

    return run


def _compare(table: pa.Table) -> pa.Table:
    ids, marks, tail = (table.column(c).to_numpy() for c in ("id", "mark", "tail"))
    order = np.lexsort((marks, ids, tail))
    own = int((~tail).sum())
    open_, packed = zstandard.ZstdDecompressor(), table.column("packed")
    rows, at = [], 0
    while at < own:  # some documents at once, and the one after them
        texts: list[str] = []
        while at + len(texts) < len(order) and len(texts) <= min(500, own - at) and sum(map(len, texts[:-1])) < 4 * PIECE:
            texts.append(open_.decompress(packed[order[at + len(texts)]].as_py()).decode())
        n = len(texts) - 1
        if not n:  # nothing follows: only where rows were lost
            raise ValueError("a shard has no row after its last")
        prints = fingerprints(texts)
        for k in range(n):
            changed = edited(texts[k], texts[k + 1])
            digest, print_ = hashlib.sha256(changed.encode()).hexdigest(), None
            rows.append([ids[order[at + k]], len(texts[k]), digest, prints[k], print_, None, likeness(prints[k], prints[k + 1])])
        for k in range(0, n, 100):
            changed_prints = fingerprints([edited(texts[i], texts[i + 1]) for i in range(k, min(k + 100, n))])
            for row, print_ in zip(rows[len(rows) - n + k :], changed_prints, strict=False):
                row[4], row[5] = print_, likeness(row[3], print_)
        at += n
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types, strict=True)], names=names)


def fingerprint_and_compare(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next one's are.

    The next document is the next in ascending id; the first follows the last. Rows that share an id
    are ordered by a hash of their text; null ids come first; a null text counts as empty. A table
    of one row is followed by itself. Other columns are not read.
    """
    x = id_text(documents, id_col, text_col)
    n = partitions(documents.sparkSession)
    bounds, keys = np.array(range_bounds(x, 4 * n), np.int64), even_keys(n, 4)
    found = x.mapInArrow(lean(_places(bounds)), "shard long, id long, mark long").groupBy("shard").agg(F.min(F.struct("id", "mark")).alias("first")).collect()  # a row a shard
    firsts = {r["shard"]: (r["first"]["id"], r["first"]["mark"]) for r in found}
    out = x.mapInArrow(lean(_route(bounds, firsts, keys)), _ROUTED).groupBy("shard").applyInArrow(lean(_compare), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(outer_id().alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@lru_cache(1)
def _lenders() -> np.ndarray:
    """For each cell, the order in which it asks all cells, itself first, for a value."""
    rng = np.random.default_rng(12)
    return np.array([[k, *(c for c in rng.permutation(CELLS) if c != k)] for k in range(CELLS)])


def filled(fingerprint: str) -> str:
    """The fingerprint of CELLS cells, each empty one with the value of the first that has one in an order of its own, so that they borrow independently."""
    cells = np.array([fingerprint[i : i + 2] for i in range(0, len(fingerprint), 2)])
    has = cells != EMPTY
    if has.all() or not has.any():
        return fingerprint
    order = _lenders()
    return "".join(cells[order[np.arange(CELLS), has[order].argmax(axis=1)]].tolist())


def _printed(batches):
    for batch in batches:
        flat, at = raw_bytes(batch.column("text"))
        for i, j in slices(at, 1 << 20):
            texts = [flat[at[r] : at[r + 1]].tobytes().decode() for r in range(i, j)]
            prints = [filled(p) for p in fingerprints(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], names=["id", "n", "cells"])


def bands_of(texts: DataFrame, bands: int, band_cells: int) -> DataFrame:
    """(id, n, band): the bands of each text (id, text), and its length.

    Short texts fill few cells. Were empty cells compared as they are, a third of the bands of all
    short texts would be one and the same; filled from other cells they tell texts apart.
    """
    prints = texts.mapInArrow(lean(_printed), "id long, n long, cells string")
    rng = np.random.default_rng(9)
    keys = [F.concat(F.lit(f"{b}:"), *[F.substring("cells", 2 * int(c) + 1, 2) for c in rng.choice(CELLS, band_cells, replace=False)]) for b in range(bands)]
    return prints.select("id", "n", F.explode(F.array_distinct(F.array(*keys))).alias("band"))


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, by bit rows over the longer text; common ends are left out first. Beyond `most` any number above it."""
    if len(a) < len(b):
        a, b = b, a
    head = 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not b or most is not None and len(a) - len(b) > most:
        return len(a)
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for k, y in enumerate(b):
        if most is not None and distance - (len(b) - k) > most:  # each of the rest takes off one at best
            return distance - (len(b) - k)
        same = at.get(y, 0)
        level = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (full & ~(level | up)), up & level
        distance += 1 if rise & top else -1 if fall & top else 0
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | (full & ~(level | rise)), rise & level
    return distance


def edit_similarity(similarity: float):
    """A function of two texts: 1 - distance / longer length; some lower number where that is below `similarity`."""

    @F.pandas_udf(DoubleType())
    def measure(s: pd.Series, t: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> float:
            n = max(1, len(a), len(b))
            return 1 - edit_distance(a, b, math.floor((1 - similarity) * n + 1e-9)) / n

        return pd.Series([one(a, b) for a, b in zip(s, t, strict=True)], dtype="float64")

    return measure


def _alike_in_length(similarity: float):
    return F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9


def near_pairs(documents: DataFrame, similarity: float = 0.8, bands: int = 20, band_cells: int = 4, id_col: str = "doc_id", text_col: str = "text", exact: bool = True, deals: int = 16) -> DataFrame:
    """(a, b, edit_similarity), a < b: pairs of different texts whose edit similarity, 1 - distance / longer length, is at least `similarity`.

    exact: every pair of texts whose lengths allow the similarity is verified by its edit distance, so
    no pair is lost. At 0.8 one character in five may differ, and segments that an edit must leave
    whole are under five characters long: they rule out next to nothing in prose, only lengths do.
    The work grows with the square of the texts of a length band, dealt to `deals` tasks each way.

    Else bit-sampled banding: a band is the value of band_cells cells drawn at random; pairs that share a
    band are candidates, found by a join on the band, and each is verified by its edit distance.
    That finds copies with edits in one place, and loses most pairs whose edits are scattered over
    the text (README has the measured shares). Of texts under some 15 characters, many
    share a band by chance: their candidates grow with the square of the texts that are so short.

    Equal texts are one class, named by their smallest id, so copies make no pairs. Texts so short
    that one edit is too much have no partner.
    """
    x = id_text(documents, id_col, text_col).where("text <> ''").groupBy("text").agg(F.min("id").alias("id")).select("id", "text")
    long_enough = x.where(F.char_length("text") * (1 - similarity) >= similarity - 1e-9)
    if exact:
        length = F.char_length("text")
        step = math.log(1 / similarity) * (1 + 1e-9) if 0 < similarity < 1 else math.inf
        sized = long_enough.select("id", "text", length.alias("n"), F.floor(F.log(length.cast("double")) / step).alias("g"))
        left = sized.select(F.col("id").alias("a"), F.col("text").alias("s"), "n", F.explode(F.array("g", F.col("g") - 1, F.col("g") + 1)).alias("g"), F.pmod(F.xxhash64("text"), F.lit(deals)).alias("deal"))
        right = sized.select(F.col("id").alias("b"), F.col("text").alias("t"), F.col("n").alias("m"), "g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("deal"))
        both = left.join(right, ["g", "deal"]).where("a < b").where(_alike_in_length(similarity))
    else:
        banded = bands_of(long_enough, bands, band_cells)
        other = banded.select(F.col("id").alias("b"), F.col("n").alias("m"), "band")
        close = banded.withColumnRenamed("id", "a").join(other, "band").where("a < b").where(_alike_in_length(similarity)).select("a", "b").distinct()
        both = close.join(x.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").join(x.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")
    scored = both.select("a", "b", edit_similarity(similarity)("s", "t").alias("edit_similarity"))
    return scored.where(F.col("edit_similarity") >= similarity - 1e-12).select(outer_id("a").alias("a"), outer_id("b").alias("b"), "edit_similarity")


#: Two texts stand at the first of these levels that is not below the number of cells filled in either.
LEVELS = (12, 18, 27, 36, 48, 64)
BANDS = 36  # of a level, at most, where the similarity allows
BLOCK = 4096  # fingerprints of a band that one task holds against others
VOID = 256  # an empty cell as a number


@lru_cache(1)
def _alike() -> np.ndarray:
    """Likeness by (equal cells, cells filled in either)."""
    out = np.zeros((CELLS + 1, CELLS + 1))
    for n in range(1, CELLS + 1):
        for k in range(n + 1):
            equal = k / n
            out[k, n] = 2 * equal / (1 + equal)
    return out


@lru_cache(4)
def _sieve(similarity: float) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """(cells of the bands of each level, whether a text with so many filled cells has a level's bands).

    Two texts of a level differ in d cells at most. Of d + 1 + k groups of cells at least k + 1 are equal;
    the groups are dealt to k classes, so two equal ones are of one class: a band is two groups of a class.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity: above 0, up to 1")
    near = _alike() >= similarity
    order = np.random.default_rng(9).permutation(CELLS)
    levels, takes = [], np.zeros((CELLS + 1, len(LEVELS)), bool)
    for level, (low, high) in enumerate(zip((0, *LEVELS), LEVELS, strict=False)):
        d = max(n - int(near[:, n].argmax()) for n in range(low + 1, high + 1))
        ways = []
        for groups in range(d + 2, CELLS + 1):
            cells = np.array_split(order, groups)
            ways.append([np.r_[cells[a], cells[b]] for own in np.array_split(np.arange(groups), groups - d - 1) for a, b in combinations(own, 2)])
        if not ways:
            raise ValueError("at so low a similarity texts need not share two cells")
        levels.append(next((w for w in ways if len(w) <= BANDS), min(ways, key=len)))  # the first has the largest groups
        for n in range(1, high + 1):  # n filled cells in one of two near texts: up to as many in either as n equal ones allow
            takes[n, level] = int(np.flatnonzero(near[n]).max()) > low
    return levels, takes


def _cells(prints: list[str]) -> np.ndarray:
    """A row of numbers for each fingerprint, VOID where a cell is empty."""
    x = np.frombuffer("".join(prints).encode(), np.uint8).reshape(-1, CELLS, 2)
    digit = np.where(x > 96, x - 87, x - 48).astype(np.uint16)
    return np.where(x[:, :, 0] == ord(EMPTY[0]), np.uint16(VOID), digit[:, :, 0] * np.uint16(16) + digit[:, :, 1])


def _likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """likeness of rows of cells, by numpy's rules of shapes; a cell at a time, in bytes."""
    a, b = (np.ascontiguousarray(np.moveaxis(x, -1, 0)) for x in (a, b))
    equal = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]), np.uint8)
    void = np.zeros_like(equal)
    for x, y in zip(a, b, strict=True):
        equal += x == y
        if (x == VOID).any() and (y == VOID).any():
            void += (x == VOID) & (y == VOID)
    return _alike()[equal - void, CELLS - void]


def _banded(similarity: float):
    """(c, band) of fingerprints: hashes of the cells of their bands, empty ones included. Texts without characters have none."""
    levels, takes = _sieve(similarity)

    def run(batches):
        for batch in batches:
            cells, c = _cells(batch.column("fingerprint").to_pylist()), batch.column("c").to_numpy()
            count = (cells != VOID).sum(axis=1)
            for level, bands in enumerate(levels):
                rows = np.flatnonzero(takes[count, level])
                own = np.ascontiguousarray(cells[rows].T.astype(np.uint64))
                band = np.zeros((len(rows), len(bands)), np.uint64)
                for k, picked in enumerate(bands):
                    band[:, k] = level << 16 | k
                    for cell in picked:
                        band[:, k] = _mix((band[:, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ own[cell])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c[rows], len(bands))), pa.array(band.reshape(-1).view(np.int64))], names=["c", "band"])

    return run


@F.pandas_udf(DoubleType())
def _likeness(s: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series(_likenesses(_cells(s.tolist()), _cells(t.tolist())), dtype="float64")


def _block(c: np.ndarray, cells: np.ndarray, far: np.ndarray, similarity: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(c, b, e) of a block's rows, in which those marked far meet all others: each one's least near b < c, and a forest (e null) of all links found."""
    names, at = np.unique(c, return_inverse=True)
    part, out = np.arange(len(names)), []
    left, right = np.flatnonzero(far), np.flatnonzero(~far)
    right = right[np.argsort(c[right])]
    step = max(1, 100_000 // max(1, len(right)))
    for i in range(0, len(left) if len(right) else 0, step):
        rows = left[i : i + step]
        like = _likenesses(cells[rows][:, None], cells[right][None])
        near = (like >= similarity) & (at[rows][:, None] != at[right][None])
        less = near & (at[right][None] < at[rows][:, None])
        k = less.argmax(axis=1)  # right ascends
        has = np.flatnonzero(less.any(axis=1))
        out.append((c[rows[has]], c[right[k[has]]], like[has, k[has]]))
        for r in np.flatnonzero(near.any(axis=1)):
            met = np.unique(np.append(part[at[right[near[r]]]], part[at[rows[r]]]))
            if len(met) > 1:
                part[np.isin(part, met)] = met[0]
    moved = np.flatnonzero(part != np.arange(len(names)))
    return [*out, (names[moved], names[part[moved]], np.full(len(moved), np.nan))]


def _blocks(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        band, i, j, c = (table.column(x).to_numpy() for x in ("band", "i", "j", "c"))
        far, cells = table.column("far").to_numpy(), _cells(table.column("fingerprint").to_pylist())
        order = np.lexsort((j, i, band))
        key = np.stack([band, i, j])[:, order]
        edges = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, len(order)]
        found = [x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in _block(c[order[a:b]], cells[order[a:b]], far[order[a:b]], similarity)]
        a, b, e = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"c": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "e": pa.array(e, pa.float64(), mask=np.isnan(e))})

    return run


def _links(classes: DataFrame, rows: int, similarity: float) -> DataFrame:
    """(c, b, e), b < c: links among classes (c, fingerprint). Those with e hold each c's least near b; all together connect what near pairs connect.

    Members of a band are held against its least, b. Two that are both near to it need not meet: it connects them
    and is less than either. One that is not meets all members of the band, in blocks that are dealt to tasks.
    """
    n = partitions(classes.sparkSession)
    banded = classes.select("c", "fingerprint").mapInArrow(lean(_banded(similarity)), "c long, band long")
    least = banded.groupBy("band").agg(F.min("c").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a band that holds more than 1/10,000 of all would fill one task: there are some 10,000 of those at most
    hot = max(10_000, rows * BANDS // 10_000)
    met = checkpointed(banded.join(least.where(F.col("n") <= hot), "band").unionByName(banded.join(F.broadcast(least.where(F.col("n") > hot)), "band")))
    pairs = checkpointed(met.where("b < c").select("c", "b").distinct())
    both = join_spread(pairs, classes.select(F.col("c").alias("b"), F.col("fingerprint").alias("t")), "b").join(classes.select("c", F.col("fingerprint").alias("s")), "c")
    held = checkpointed(both.select("c", "b", _likeness("s", "t").alias("e")))
    apart = held.where(F.col("e") < similarity).select("c", "b", F.lit(True).alias("apart"))
    members = checkpointed(met.where("n > 2").join(apart, ["c", "b"], "left").select("band", "c", "n", "apart"))
    # u members that are apart, n members: so many parts of either
    parts = lambda x: F.ceil(F.col(x) / BLOCK).cast("long")
    unmet = members.groupBy("band").agg(F.count("apart").alias("u"), F.first("n").alias("of")).where("u > 0").select("band", "u", parts("u").alias("us"), parts("of").alias("ns"), "of")
    unmet = checkpointed(unmet)
    size = unmet.agg(F.sum(F.col("u") * F.col("ns") + F.col("of") * F.col("us"))).first()[0] or 0
    slots = n * max(4, size // (n * 20_000) + 1)
    place = F.xxhash64("c")
    i, j = F.pmod(place, "us"), F.pmod(place, "ns")
    range_to = lambda x: F.sequence(F.lit(0).cast("long"), F.col(x) - 1)
    as_other = F.transform(range_to("us"), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(False).alias("far")))
    as_far = F.transform(range_to("ns"), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(True).alias("far")))
    dealt = join_spread(members, unmet.select("band", "us", "ns"), "band").join(classes.select("c", "fingerprint"), "c")
    dealt = dealt.select("band", "c", "fingerprint", F.explode(F.when(F.col("apart"), F.concat(as_other, as_far)).otherwise(as_other)).alias("x")).select("band", "c", "fingerprint", "x.*")
    more = dealt.withColumn("slot", F.pmod(F.xxhash64("band", "i", "j"), F.lit(slots))).groupBy("slot").applyInArrow(lean(_blocks(similarity)), "c long, b long, e double")
    return held.where(F.col("e") >= similarity).unionByName(checkpointed(more))


def with_near_first(compared: DataFrame, similarity: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """compared (fingerprint_and_compare's rows) with near_first, near_first_likeness and near_class.

    Two documents are linked if their fingerprints' likeness is at least `similarity`. near_first is the least id
    a document is linked with among those before it, copies included, null if there is none; near_class the least
    id that links reach, its own if there is none. No link is lost: bit-sampled bands, so drawn that any two
    fingerprints of that likeness share one, give the candidates, and the Hamming distance of the whole
    fingerprints, as likeness states it, verifies them. Equal fingerprints are one node, and members of a band that are near
    to its first aren't held against each other, so a group of near copies costs rows in proportion to
    its documents. Texts without characters are near to each other only. Null ids come first and are given as null:
    near_first_likeness tells a link with such a document from none.
    Rows of one id with different fingerprints are nodes of their own, and stand in the order of their fingerprints' hashes.
    """
    spark = compared.sparkSession
    folder, numbered = shared_folder(spark, "fingerprints"), shared_folder(spark, "classes")
    compared.write.option("compression", "zstd").parquet(folder)
    compared = spark.read.parquet(folder)
    rows = compared.count()
    key = F.coalesce(F.col(id_col), F.lit(NULL_ID))
    classes = compared.groupBy("fingerprint").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))
    # numbers that ascend with the first document, one a fingerprint also where several hold one id; hashes keep the samples of the sort small
    ordered = classes.withColumn("mark", F.xxhash64("fingerprint")).repartitionByRange("first", "mark").sortWithinPartitions("first", "mark", "fingerprint").drop("mark")
    ordered.withColumn("c", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(numbered)
    classes = spark.read.parquet(numbered)
    links = _links(classes, rows, similarity)
    best = links.where("e is not null").groupBy("c").agg(F.min(F.struct("b", "e")).alias("f")).select("c", "f.b", "f.e")
    firsts = classes.select(F.col("c").alias("b"), F.col("first").alias("_b"))
    best = join_spread(checkpointed(best), firsts, "b").select("c", "_b", F.col("e").alias("_e"))
    reached = connected_components(links.select(F.col("c").alias("a"), "b")).where("node <> component")
    reached = join_spread(checkpointed(reached), firsts.toDF("component", "_class"), "component").select(F.col("node").alias("c"), "_class")
    named = classes.join(best, "c", "left").join(reached, "c", "left").where("copies > 1 or _class is not null").select("fingerprint", "first", "_b", "_e", "_class")
    out = join_spread(compared, named, "fingerprint", "left", rows)
    copy = key != F.col("first")
    near = F.coalesce("_b", F.when(copy, F.col("first")))
    return out.select(
        *compared.columns,
        F.when(near != NULL_ID, near).alias("near_first"),
        F.coalesce("_e", F.when(copy, F.lit(1.0))).alias("near_first_likeness"),
        F.nullif(F.coalesce("_class", "first", key), F.lit(NULL_ID)).alias("near_class"),
    )
