"""Exact removal of repeated byte strings by distributed prefix doubling.

Every byte covered by a `length`-byte string that also starts earlier in the corpus (smaller
document id, or earlier in the same document) is removed. Strings are judged on the input.

A dense suffix array needs a sort of one row per byte and round, many times the input on disk.
This form doubles prefixes over a sparse set of positions that loses nothing: in every string of
`length` bytes the smallest hashed prefix of k = length/4 bytes marks one anchor, and equal strings
mark the same one. The rank of a prefix of 2n bytes is made from the pair of ranks at p and at p + n.

  k bytes   ranks are names of the bytes; they choose the anchors
  2k bytes  pairs (rank at p, rank at p + k) that a string holds to the right of its anchor p, or (p - k, p)
            for strings that end too early; sorted by Spark, ranked anew, and unique pairs leave. Anchors whose
            whole surroundings are equal keep only the first: the strings of the others are repeats already
  4k bytes  pairs (rank of 2k at s, rank of 2k at s + length - 2k) of every string s that is left, overlapping
            where 4k passes the threshold; sorted by Spark; all but the first of a rank are repeats

Each round is one shuffle by rank, with repeats of a rank folded before it, so a passage held
by a third of all documents reaches a reducer as one row a map task. Pairs that are very frequent
in different surroundings (rules, padding, short boilerplate) are found in a bounded sample; they are
sure not to be unique, so their rows are dealt by their surroundings, not to one task.

Ranks that decide which bytes go are 96 bits of two independent names: among 10^12 strings the
odds of one false match are some 10^-5. Shorter ones only sort, and lose nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, even_keys, id_text, lean, outer_id, partitions, raw_bytes, short_batches, slices, spread

SEED = 0x9E3779B97F4A7C15
STEP_BYTES = 1 << 20  # text hashed at once
FLUSH = 12 << 20  # text whose anchors are folded before they leave a map task
SAMPLE_BYTES = 32 << 20  # text in which frequent pairs are looked for
FREQUENT = 20  # no pair that it holds less often is frequent
ONES = np.uint64(0xFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """The name of two names one after the other."""
    return _mix(a * np.uint64(0x9FB21C651E98DF25) + _mix(b + np.uint64((salt * 2 + 1) * SEED % 2**64)))


#: Two independent polynomials: the value of each byte, and the base.
_TABLES = [_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(SEED)), _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))]
_BASES = (0xF1357AEA2E62A9C5, 0xE7037ED1A0B428DB)
_powers: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def _pow(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """base**i and base**-i modulo 2**64, for either base."""
    if n > next(iter(_powers), 0):
        made = []
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, 2**64)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
            made.append(tuple(both))
        _powers.clear()
        _powers[n] = made
    return [(up[:n], down[:n]) for up, down in next(iter(_powers.values()))]


class Names:
    """Names of the byte strings of one buffer, in two independent streams: equal strings have equal names."""

    def __init__(self, data: np.ndarray):
        self.sums, self.down = [], []
        for table, (up, down) in zip(_TABLES, _pow(len(data) + 1), strict=True):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * up[:-1], out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    def of(self, start: np.ndarray, end: np.ndarray, stream: int = 0) -> np.ndarray:
        x = (self.sums[stream][end] - self.sums[stream][start]) * self.down[stream][start]
        return _mix(x + (end - start).astype(np.uint64) * np.uint64(SEED))

    def all(self, n: int) -> np.ndarray:
        sums, down = self.sums[0], self.down[0]
        return _mix((sums[n:] - sums[:-n]) * down[: len(sums) - n] + np.uint64(n * SEED % 2**64))

    def doubled(self, start: np.ndarray, length: int, stream: int) -> np.ndarray:
        """Names of length bytes at each start, from the ranks at k, by pairs at k and at length - 2k."""
        k = -(-length // 4)

        def two(s):
            return pair(self.of(s, s + k, stream), self.of(s + k, s + 2 * k, stream))

        return pair(two(start), two(start + (length - 2 * k)))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray] | None:
    """The anchors of some documents by the pair of ranks beside them, and which strings (by distance to their start) chose each."""
    k, n = -(-length // 4), len(data)
    if n < length:
        return None
    names = Names(data)
    grams = names.all(k)
    width = length - k + 1
    keys = np.full(n, ~np.uint64(0), np.uint64)
    keys[: len(grams)] = (grams & ~ONES) | np.arange(len(grams), dtype=np.uint64)
    least, have = keys, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    # least[p]: smallest key of the prefixes inside the string that starts at p
    sizes = np.diff(offsets)
    count = np.maximum(sizes - length + 1, 0)
    starts = spread(offsets[:-1], count)
    if not len(starts):
        return None
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), count)
    chosen = (least[starts] & ONES).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:], len(starts)] - 1
    a, low, high, doc = chosen[new], starts[new], starts[last], doc[new]
    cut = length - 2 * k  # strings that start at most so far before the anchor hold 2k bytes to its right
    to_right, to_left = np.flatnonzero(a - high <= cut), np.flatnonzero(a - low > cut)
    rank = np.r_[pair(grams[a[to_right]], grams[a[to_right] + k]), pair(grams[a[to_left] - k], grams[a[to_left]], 1)]
    near = np.r_[(a - high)[to_right], np.maximum(a - high, cut + 1)[to_left]]
    far = np.r_[np.minimum(a - low, cut)[to_right], (a - low)[to_left]]
    rows = np.r_[to_right, to_left]
    order = np.argsort(rows, kind="stable")  # so that places ascend, which packs better
    rank, near, far, a, doc = rank[order], near[order], far[order], a[rows[order]], doc[rows[order]]
    shape = _mix(near.astype(np.uint64) * np.uint64(1000003) + far.astype(np.uint64))
    low, high = a - far, a - near + length
    around, more = names.of(low, high) ^ shape, (names.of(low, high, 1) ^ shape) >> np.uint64(32)
    few = {"doc": doc, "pos": a - offsets[:-1][doc], "near": near, "far": far}
    return {k: v.astype(np.int32) for k, v in few.items()} | {"rank": rank, "around": around, "more": more.astype(np.uint32)}


def _first(key: tuple[np.ndarray, ...], ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: is it as early as the first of its key; and how many rows the key has."""
    order = np.lexsort((pos, ids, *key[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in key:
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    group = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)]
    first, size = np.empty(len(order), bool), np.empty(len(order), np.int64)
    first[order] = (ids[order] == ids[head][group]) & (pos[order] == pos[head][group])
    size[order] = np.bincount(group)[group]
    return first, size


def _size(*key: np.ndarray) -> np.ndarray:
    return _first(key, zero := np.zeros(len(key[0]), np.int64), zero)[1]


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans by document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    most = int(end.max()) + 2
    reach = np.maximum.accumulate(end + doc * most)
    new = np.r_[True, start[1:] + doc[1:] * most > reach[:-1]]
    at = np.flatnonzero(new)
    return doc[at], start[at], (reach[np.r_[at[1:], len(doc)] - 1] - doc[at] * most)


_PACK = {"doc": np.int32, "pos": np.int32, "near": np.int32, "far": np.int32, "rank": np.uint32, "around": np.uint64, "more": np.uint32, "hot": np.uint8, "start": np.int32, "end": np.int32, "name": np.uint64}


def _pack(columns: dict[str, np.ndarray], ids: np.ndarray, marks: np.ndarray) -> bytes:
    """Rows and the documents that they name, column by column, compressed."""
    used, doc = np.unique(columns["doc"], return_inverse=True)
    parts = [np.array([len(used), len(doc)], np.int64).tobytes(), np.diff(ids[used].astype(np.int64), prepend=0).tobytes(), marks[used].astype(np.int64).tobytes()]
    parts += [(doc if k == "doc" else v).astype(_PACK[k]).tobytes() for k, v in columns.items()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blobs: list[bytes], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The rows of several packs; doc becomes a number of (id, mark), which come with it."""
    out: dict[str, list] = {k: [] for k in (*names, "id", "mark")}
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        docs, rows = np.frombuffer(raw, np.int64, 2)
        at = 16
        table = np.frombuffer(raw, np.int64, 2 * docs, at).reshape(2, docs)
        at += 16 * docs
        for k in names:
            out[k].append(np.frombuffer(raw, _PACK[k], rows, at))
            at += rows * np.dtype(_PACK[k]).itemsize
        doc = out["doc"][-1]
        out["id"].append(np.cumsum(table[0])[doc])
        out["mark"].append(table[1][doc])
    made = {k: np.concatenate(v) if v else np.zeros(0, _PACK.get(k, np.int64)) for k, v in out.items()}
    return made


def _docs(id_: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number the (id, mark) pairs: row -> number, ids, marks."""
    pairs = np.stack([id_, mark], 1)
    if not len(pairs):
        return np.zeros(0, np.int64), pairs[:, 0], pairs[:, 1]
    table, doc = np.unique(pairs, axis=0, return_inverse=True)
    return doc.reshape(-1), table[:, 0], table[:, 1]


_OUT = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("pack", pa.binary())])
SCHEMA = "bucket long, kind int, pack binary"
ANCHOR = ("doc", "pos", "near", "far", "rank", "around", "more", "hot")
SPAN, WANT, STRING = ("doc", "start", "end"), ("doc", "pos", "near", "far"), ("doc", "start", "name", "more")


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else ((), (), ()), _OUT, strict=True)], schema=_OUT)


def _by(bucket: np.ndarray, kind: int, columns: dict[str, np.ndarray], ids: np.ndarray, marks: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A pack for each bucket; buckets are named by keys, so that each is dealt to a task of its own."""
    out, order = [], np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(order) else []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        rows = order[i:j]
        out.append((int(keys[bucket[rows[0]]]), kind, _pack({k: v[rows] for k, v in columns.items()}, ids, marks)))
    return out


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return (x % np.uint64(n)).astype(np.int64)


def _block(ids: np.ndarray, marks: np.ndarray, n: int) -> np.ndarray:
    """The block of documents: rows that share an id, or have none, are spread by their marks."""
    return _bucket(pair(ids.astype(np.int64).view(np.uint64), marks.astype(np.int64).view(np.uint64)), n)


def _mark(text: bytes) -> int:
    """Spark's xxhash64 of the text."""
    x = xxhash.xxh64_intdigest(text, 42)
    return x - 2**64 if x >= 2**63 else x


def _spans(found: dict[str, np.ndarray], keys: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Merged spans, sent to the block of their document."""
    doc, ids, marks = _docs(found["id"], found["mark"])
    doc, start, end = _merged(doc, found["start"].astype(np.int64), found["end"].astype(np.int64))
    return _by(_block(ids[doc], marks[doc], len(keys)), 1, {"doc": doc, "start": start, "end": end}, ids, marks, keys)


def _texts(batches):
    """(bytes of some texts, offsets, ids, marks); marks tell rows of one id apart."""
    for batch in batches:
        flat, at = raw_bytes(batch.column("text"))
        ids, marks = batch.column("id").to_numpy(zero_copy_only=False), batch.column("mark").to_numpy(zero_copy_only=False)
        for i, j in slices(at, STEP_BYTES):
            yield flat[at[i] : at[j]], at[i : j + 1] - at[i], ids[i:j], marks[i:j]


def frequent_pairs(length: int):
    """(rank, n) of the anchors of some texts."""

    def run(batches):
        for data, offsets, _, _ in _texts(batches):
            for found, _, _ in _parts(data, offsets, length):
                rank, n = np.unique(found["rank"].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(n)], names=["rank", "n"])

    return run


def anchor_rows(length: int, keys: np.ndarray, frequent: np.ndarray):
    """Map side of the round at 2k bytes: packed anchors by rank, and spans that are sure by now."""
    n = len(keys)

    def flush(parts, ids, marks):
        ids, marks = np.concatenate(ids), np.concatenate(marks)
        x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        first, _ = _first((x["around"], x["more"]), ids[x["doc"]], x["pos"])
        sure = ~first
        spans = {"id": ids[x["doc"][sure]], "mark": marks[x["doc"][sure]], "start": x["pos"][sure] - x["far"][sure], "end": x["pos"][sure] - x["near"][sure] + length}
        hot = np.isin(x["rank"], frequent)
        bucket = _bucket(np.where(hot, x["around"], x["rank"]) >> np.uint64(33), n)
        x |= {"rank": x["rank"] & np.uint64(0xFFFFFFFF), "hot": hot}
        return _by(bucket[first], 0, {k: x[k][first] for k in ANCHOR}, ids, marks, keys) + _spans(spans, keys)

    def run(batches):
        parts, ids, marks, held, docs = [], [], [], 0, 0
        for data, offsets, own, own_marks in _texts(batches):
            for found, lo, _ in _parts(data, offsets, length):
                found["doc"] += np.int32(docs + lo)
                parts.append(found)
            ids.append(own)
            marks.append(own_marks)
            docs += len(own)
            held += len(data)
            if held >= FLUSH:
                if parts:
                    yield _batch(flush(parts, ids, marks))
                parts, ids, marks, held, docs = [], [], [], 0, 0
        if parts:
            yield _batch(flush(parts, ids, marks))

    return run


def _parts(data: np.ndarray, offsets: np.ndarray, length: int):
    """Anchors of documents; one longer than a step is cut, overlapping so that no string is lost."""
    if len(data) <= 2 * STEP_BYTES or len(offsets) > 2:
        if found := anchors(data, offsets, length):
            yield found, 0, len(offsets) - 1
        return
    for at in range(0, len(data) - length + 1, STEP_BYTES):
        piece = data[at : at + STEP_BYTES + length - 1]
        if found := anchors(piece, np.array([0, len(piece)]), length):
            found["pos"] += np.int32(at)
            yield found, 0, 1


def rank_anchors(length: int, keys: np.ndarray):
    """Reduce side of the round at 2k bytes."""

    def run(table: pa.Table) -> pa.Table:
        kind, packs = table.column("kind").to_numpy(), table.column("pack").to_pylist()
        out = _spans(_unpack([p for p, k in zip(packs, kind, strict=True) if k == 1], SPAN), keys)
        x = _unpack([p for p, k in zip(packs, kind, strict=True) if k == 0], ANCHOR)
        if len(x["doc"]):
            x = {k: v.astype(np.int64) if k in ("pos", "near", "far") else v for k, v in x.items()}
            first, _ = _first((x["around"], x["more"]), x["id"], x["pos"])
            sure = {k: v[~first] for k, v in x.items()}
            out += _spans(sure | {"start": sure["pos"] - sure["far"], "end": sure["pos"] - sure["near"] + length}, keys)
            x = {k: v[first] for k, v in x.items()}
            keep = (_size(x["rank"]) > 1) | (x["hot"] > 0)
            doc, ids, marks = _docs(x["id"][keep], x["mark"][keep])
            out += _by(_block(ids[doc], marks[doc], len(keys)), 0, {"doc": doc, **{k: x[k][keep] for k in ("pos", "near", "far")}}, ids, marks, keys)
        return pa.Table.from_batches([_batch(out)])

    return run


def _named(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the strings at ascending starts, from no more than a step of the text at once."""
    names, more = [], []
    at = 0
    while at < len(start):
        gap = np.flatnonzero(np.diff(start[at : at + STEP_BYTES]) > 16 * length)
        to = min(at + (int(gap[0]) + 1 if len(gap) else STEP_BYTES), len(start))
        to = at + int(np.searchsorted(start[at:to], start[at] + STEP_BYTES))
        part = Names(data[start[at] : start[to - 1] + length])
        own = start[at:to] - start[at]
        names.append(part.doubled(own, length, 0))
        more.append(part.doubled(own, length, 1) >> np.uint64(32))
        at = to
    return np.concatenate(names), np.concatenate(more)


def name_strings(length: int, keys: np.ndarray):
    """The round at 4k bytes, map side: pairs of ranks of the strings that are still in question, from their documents."""

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        kind, packs = table.column("kind").to_pylist(), table.column("pack").to_pylist()
        out = _spans(_unpack([p for p, k in zip(packs, kind, strict=True) if k == 1], SPAN), keys)  # one row for all that is sure by now
        x = _unpack([p for p, k in zip(packs, kind, strict=True) if k == 0], WANT)
        if len(x["doc"]):
            ids, marks = docs.column("id").to_numpy(), docs.column("mark").to_numpy()
            texts = {(int(i), int(m)): r for r, (i, m) in enumerate(zip(ids, marks, strict=True))}
            doc, want_ids, want_marks = _docs(x["id"], x["mark"])
            order = np.argsort(doc, kind="stable")
            edges = np.searchsorted(doc[order], np.arange(len(want_ids) + 1))
            names, mores, starts, owner = [], [], [], []
            packed, open_ = docs.column("packed"), zstandard.ZstdDecompressor()
            for d in range(len(want_ids)):
                rows = order[edges[d] : edges[d + 1]]
                data = np.frombuffer(open_.decompress(packed[texts[int(want_ids[d]), int(want_marks[d])]].as_py()), np.uint8)
                low = x["pos"][rows].astype(np.int64) - x["far"][rows]
                start = np.unique(spread(low, (x["far"][rows] - x["near"][rows] + 1).astype(np.int64)))
                name, more = _named(data, start, length)
                names.append(name)
                mores.append(more)
                starts.append(start)
                owner.append(np.full(len(start), d))
            x = {"name": np.concatenate(names), "more": np.concatenate(mores), "start": np.concatenate(starts), "doc": np.concatenate(owner)}
            first, _ = _first((x["name"], x["more"]), want_ids[x["doc"]], x["start"])
            sure = {k: v[~first] for k, v in x.items()}
            out += _spans({"id": want_ids[sure["doc"]], "mark": want_marks[sure["doc"]], "start": sure["start"], "end": sure["start"] + length}, keys)
            bucket = _bucket(x["name"] >> np.uint64(20), len(keys))[first]
            out += _by(bucket, 0, {k: x[k][first] for k in STRING}, want_ids, want_marks, keys)
        return pa.Table.from_batches([_batch(out)])

    return run


def rank_strings(length: int, keys: np.ndarray):
    """The round at 4k bytes, reduce side."""

    def run(table: pa.Table) -> pa.Table:
        kind, packs = table.column("kind").to_pylist(), table.column("pack").to_pylist()
        out = _spans(_unpack([p for p, k in zip(packs, kind, strict=True) if k == 1], SPAN), keys)
        x = _unpack([p for p, k in zip(packs, kind, strict=True) if k == 0], STRING)
        if len(x["doc"]):
            first, _ = _first((x["name"], x["more"]), x["id"], x["start"])
            sure = {k: v[~first] for k, v in x.items()}
            out += _spans(sure | {"end": sure["start"].astype(np.int64) + length}, keys)
        return pa.Table.from_batches([_batch(out)])

    return run


def _cut(docs: pa.Table, table: pa.Table):
    """For each document: (id, row in docs, its bytes, merged spans)."""
    x = _unpack(table.column("pack").to_pylist(), SPAN)
    doc, ids, marks = _docs(x["id"], x["mark"])
    doc, start, end = _merged(doc, x["start"].astype(np.int64), x["end"].astype(np.int64))
    edges = np.searchsorted(doc, np.arange(len(ids) + 1))
    at = {(int(i), int(m)): d for d, (i, m) in enumerate(zip(ids, marks, strict=True))}
    open_, packed = zstandard.ZstdDecompressor(), docs.column("packed")
    for r, (i, m) in enumerate(zip(docs.column("id").to_pylist(), docs.column("mark").to_pylist(), strict=True)):
        d = at.get((i, m))
        spans = [] if d is None else list(zip(start[edges[d] : edges[d + 1]].tolist(), end[edges[d] : edges[d + 1]].tolist(), strict=True))
        yield i, r, open_.decompress(packed[r].as_py()), spans


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _digest(docs: pa.Table, table: pa.Table, texts: bool = True) -> pa.Table:
    rows = []
    for i, _, text, spans in _cut(docs, table):
        kept = kept_bytes(text, spans)
        rows.append((i, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if spans and texts else None))
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    types = [pa.int64()] * 4 + [pa.string()] * 2
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types, strict=True)], names=names)


def _digest_only(docs: pa.Table, table: pa.Table) -> pa.Table:
    return _digest(docs, table, texts=False)


def _rows(columns: list[str], text_col: str):
    """The whole rows, with cut texts in place of the texts; a null stays."""

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        rest = docs.column("rest").combine_chunks()
        rest = rest.chunk(0) if isinstance(rest, pa.ChunkedArray) and rest.num_chunks else rest
        null = rest.field(0).to_pylist()
        kept = [None if null[r] else kept_bytes(text, spans).decode("utf-8", "ignore") for _, r, text, spans in _cut(docs, table)]
        others = iter(range(1, rest.type.num_fields))
        return pa.Table.from_arrays([pa.array(kept, pa.string()) if c == text_col else rest.field(next(others)) for c in columns], names=columns)

    return run


def _packed(keys: np.ndarray):
    """(id, mark, packed text, block, other columns)."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            flat, at = raw_bytes(batch.column("text"))
            others = [c for c in batch.schema.names if c not in ("id", "mark", "text")]
            for i, j in slices(at, 8 << 20):
                part = batch.slice(i, j - i)
                blocks = keys[_block(part.column("id").to_numpy(), part.column("mark").to_numpy(), len(keys))]
                packed = pa.array([press.compress(memoryview(flat[at[r] : at[r + 1]])) for r in range(i, j)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), packed, pa.array(blocks), *(part.column(c) for c in others)], names=["id", "mark", "packed", "block", *others])

    return run


def _cut_by(x: DataFrame, length: int, last, schema) -> DataFrame:
    """All rounds over x (id, text and what else last needs); then last(documents of a block, their spans), whose rows have the schema."""
    if length < 2:
        raise ValueError("strings of two bytes or more")
    n = partitions(x.sparkSession)  # a block sends a row to each bucket at most: n * n rows
    keys = even_keys(n)
    facts = x.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    # the text of a row tells it apart from others of its id, where ids repeat
    x = x.withColumn("mark", F.lit(0).cast("long") if facts["rows"] == facts["ids"] else F.xxhash64("text"))
    texts = x.select("id", "mark", "text")
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_BYTES / max(1, facts["bytes"])))
    counts = texts.where(drawn).mapInArrow(lean(frequent_pairs(length)), "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n"))
    held = counts.agg(F.collect_list(F.when(F.col("n") >= max(FREQUENT, SAMPLE_BYTES // (256 * n)), F.col("rank"))).alias("ranks")).first()
    frequent = np.array(held["ranks"], np.int64).view(np.uint64)  # pairs that make a good part of a bucket, some 10 * n at most
    ranked = texts.mapInArrow(lean(anchor_rows(length, keys, frequent)), SCHEMA).groupBy("bucket").applyInArrow(lean(rank_anchors(length, keys)), SCHEMA)
    rest = f", rest {x.schema['rest'].dataType.simpleString()}" if "rest" in x.columns else ""
    packed = x.mapInArrow(lean(_packed(keys)), f"id long, mark long, packed binary, block long{rest}")  # shuffled once, read twice
    strings = packed.groupBy("block").cogroup(ranked.groupBy("bucket")).applyInArrow(lean(name_strings(length, keys)), SCHEMA)
    spans = strings.groupBy("bucket").applyInArrow(lean(rank_strings(length, keys)), SCHEMA)
    return packed.groupBy("block").cogroup(spans.groupBy("bucket")).applyInArrow(lean(last), schema)


def remove_repeats(documents: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """What is left of every row's text.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text (unless digest_only),
    which is null where nothing was removed, so that unchanged texts are not written twice; what is
    left over of a character that was cut through is dropped there, as text can't hold it.
    A null text counts as empty; a null id sorts first. Rows that repeat an id are judged by (id,
    start) alone: a string at the same start under the same id is not earlier, so equal rows get
    equal results. An empty table gives an empty result; other columns are not read. Ids are whole numbers.
    """
    out = _cut_by(id_text(documents, id_col, text_col), length, _digest_only if digest_only else _digest, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return out.select(outer_id().alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *([] if digest_only else ["kept_text"]))


def without_repeats(documents: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, their texts cut as remove_repeats says. A null text stays null."""
    short_batches(documents.sparkSession)
    others = [F.col(f"`{c}`") for c in documents.columns if c != text_col]
    x = documents.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.struct(F.col(text_col).isNull().alias("_null"), *[c.alias(f"c{i}") for i, c in enumerate(others)]).alias("rest"),
    )
    return _cut_by(x, length, _rows(documents.columns, text_col), documents.schema)
