"""Exact near-duplicate links between embeddings by a dual traversal of cover trees.

For unit vectors, cosine >= c means a chord of at most t = sqrt(2 - 2c). A cover tree holds the
points in nested levels: the points of a node of level w lie within w of its centre, its children
are of level w / 2, and their centres lie further than w / 2 apart. Of two nodes no pair can link if
their centres are further apart than both radii and t; all pairs link if centres and radii together
stay within t; else nodes are opened. What a level's bounds leave is compared in blocks.

Vectors are dealt to cells, each to its nearest centre, and cells of too many to units by a hash, so
one dense place is many tasks. Each unit's tree is built once. Its nodes of a few hundred
points go to another unit's task only if the bounds of cell and node allow a link: the cell's radius,
and the plane half way between the two centres, beyond which no vector of the other cell lies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, checkpointed, connected_components, join_spread, lean, outer_id, partitions

SLACK = 1e-6  # more than the rounding of a chord, 2e-8 at 0; links themselves are decided by the cosine
LEAF, FRONT, BLOCK = 32, 256, 1024
VISIT = 3000  # pairs of rows that are compared in the time that it takes to visit one pair of nodes


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class CoverTree:
    """Trees over the rows of x (unit vectors), which are put in the trees' order: `order` gives their old places.

    Nodes are numbered in preorder; node k holds the rows lo[k] to hi[k], its centre first. roots: top nodes.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        lo, hi, radius, depth, order = [], [], [], [], []
        todo = [(np.arange(len(x)), 2.0, 0)] if len(x) else []
        placed = 0
        while todo:
            rows, wide, level = todo.pop()
            gap = _chords(x[rows], x[rows[:1]])[:, 0]
            gap[0] = 0.0
            r = float(gap.max())
            lo.append(placed)
            hi.append(placed + len(rows))
            radius.append(r)
            depth.append(level)
            if len(rows) <= leaf or r <= SLACK:
                order.append(rows)
                placed += len(rows)
                continue
            while wide / 2 >= r:
                wide /= 2
            todo += [(part, wide / 2, level + 1) for part in reversed(_cover(x, rows, gap, wide / 2))]
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.x = x[self.order]
        self.lo, self.hi, self.depth = (np.array(v, np.int64) for v in (lo, hi, depth))
        self.radius = np.array(radius, np.float64)
        self._ready()

    def _ready(self) -> None:
        self.end = np.searchsorted(self.lo, self.hi, "left")  # the node after those below each
        self.size = self.hi - self.lo
        self.roots = np.flatnonzero(self.depth == 0)
        self.single = self.x.astype(np.float32)

    def children(self, k: int) -> np.ndarray:
        return k + 1 + np.flatnonzero(self.depth[k + 1 : self.end[k]] == self.depth[k] + 1)

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        sizes = self.size[nodes]
        return np.repeat(self.lo[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))

    def front(self, most: int = FRONT) -> np.ndarray:
        """The topmost nodes of at most `most` rows, and leaves: every row is in one."""
        fits = (self.size <= most) | (self.end == np.arange(len(self.end)) + 1)
        out, at = [], 0
        while at < len(fits):
            if fits[at]:
                out.append(at)
                at = int(self.end[at])
            else:
                at += 1
        return np.array(out, np.int64)

    def part(self, nodes: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """Trees below some nodes (none below another, ascending), and their rows."""
        rows = self.rows(nodes)
        counts = self.end[nodes] - nodes
        kept = np.repeat(nodes - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        shift = np.repeat(self.lo[nodes] - np.cumsum(self.size[nodes]) + self.size[nodes], counts)
        out = object.__new__(CoverTree)
        out.x, out.order = self.x[rows], np.arange(len(rows))
        out.lo, out.hi, out.radius = self.lo[kept] - shift, self.hi[kept] - shift, self.radius[kept]
        out.depth = self.depth[kept] - np.repeat(self.depth[nodes], counts)
        out._ready()
        return out, rows


def _cover(x: np.ndarray, rows: np.ndarray, gap: np.ndarray, wide: float) -> list[np.ndarray]:
    """The rows in parts, each within `wide` of its first row; first rows lie further apart. The first part keeps the centre."""
    inside = gap <= wide
    parts, rest = [rows[inside]], rows[~inside]
    while len(rest):
        some = rest[:BLOCK // 4]
        near = _chords(x[some], x[some]) <= wide
        open_, picks = np.ones(len(some), bool), []
        for k in range(len(some)):
            if open_[k]:
                picks.append(k)
                open_ &= ~near[k]
        centres = some[picks]
        owner = np.full(len(rest), -1)
        for at in range(0, len(rest), 8 * BLOCK):
            d = _chords(x[rest[at : at + 8 * BLOCK]], x[centres])
            owner[at : at + 8 * BLOCK] = np.where(d.min(axis=1) <= wide, d.argmin(axis=1), -1)
        owner[picks] = np.arange(len(picks))  # some are the first of rest
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(len(picks) + 1))
        for k, c in enumerate(centres):
            mine = rest[order[edges[k] : edges[k + 1]]]
            parts.append(np.r_[c, mine[mine != c]])
        rest = rest[owner < 0]
    return parts


def dual_links(left: CoverTree, right: CoverTree, cosine: float, linked, all_linked) -> int:
    """Visit every pair that links; returns how many pairs of rows were compared.

    linked(rows, rows, matrix, both) for blocks, all_linked(rows, rows, both) for nodes whose pairs all do. If left is
    right, a pair is visited once (both true: it counts for either side), or, within one set of rows, both
    ways round with a row and itself left out (both false).
    """
    reach = math.sqrt(2 - 2 * cosine)
    loose = cosine - max(1e-4, 2e-7 * left.x.shape[1])  # single precision only rules out
    compared = 0

    def direct(a: np.ndarray, b: np.ndarray, own: bool) -> None:
        nonlocal compared
        for i in range(0, len(a), BLOCK):
            for j in range(i if own else 0, len(b), BLOCK):
                p, q = a[i : i + BLOCK], b[j : j + BLOCK]
                mine = own and i == j
                compared += len(p) * len(q)
                may = left.single[p] @ right.single[q].T >= loose
                if mine:
                    np.fill_diagonal(may, False)
                if not may.any():
                    continue
                p, q = (p, q) if mine else (p[may.any(axis=1)], q[may.any(axis=0)])
                near = left.x[p] @ right.x[q].T >= cosine
                if mine:
                    np.fill_diagonal(near, False)
                if near.any():
                    linked(p, q, near, not mine)

    todo = [(left.roots, right.roots, left is right)]
    while todo:
        a, b, own = todo.pop()  # own: a is b, pairs within it
        if len(a) > BLOCK or len(b) > BLOCK:
            starts = range(0, len(a), BLOCK)
            todo += [(a[i : i + BLOCK], b[j : j + BLOCK], own and i == j) for i in starts for j in range(i if own else 0, len(b), BLOCK)]
            continue
        if (left.size[a] == 1).all() and (right.size[b] == 1).all():
            direct(left.lo[a], right.lo[b], own)
            continue
        apart = _chords(left.x[left.lo[a]], right.x[right.lo[b]])
        both = left.radius[a][:, None] + right.radius[b][None, :]
        live = apart <= both + reach + SLACK
        if own:
            live = np.triu(live)
            np.fill_diagonal(apart, 0.0)
        whole = live & (apart + both < reach - SLACK)
        pairs = int(left.size[a].sum() * right.size[b].sum()) // (1 + own)
        if pairs < VISIT * int(live.sum()) and not (own and len(a) == 1):
            direct(left.rows(a), right.rows(b), own)
            continue
        for i, j in zip(*np.nonzero(live), strict=True):
            m, n, mine = int(a[i]), int(b[j]), own and i == j
            p, q = np.arange(left.lo[m], left.hi[m]), np.arange(right.lo[n], right.hi[n])
            if whole[i, j]:
                all_linked(p, q, not mine)
                continue
            below, under = left.children(m), right.children(n)
            if len(p) * len(q) <= FRONT * LEAF or not len(below) and not len(under):
                direct(p, q, mine)
            else:
                todo.append((below if len(below) else a[i : i + 1], under if len(under) else b[j : j + 1], mine))
    return compared


class _Forest:
    """Union of rows; keeps no link, only who is together."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, groups: np.ndarray, rows: np.ndarray) -> None:
        heads: dict[int, int] = {}
        for g, r in zip(groups.tolist(), rows.tolist(), strict=True):
            r = self.root(r)
            h = self.root(heads.setdefault(g, r))
            if h != r:
                self.up[max(h, r)] = min(h, r)


def _labels(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected parts of a bipartite matrix, as labels of its rows and columns; -1 where nothing links."""
    n = len(near)
    rows, columns = np.where(near.any(axis=1), np.arange(n), n), np.full(near.shape[1], n)
    while True:
        columns = np.minimum(columns, np.where(near, rows[:, None], n).min(axis=0))
        new = np.minimum(rows, np.where(near, columns[None, :], n).min(axis=1))
        if (new == rows).all():
            return np.where(rows == n, -1, rows), np.where(columns == n, -1, columns)
        rows = new


_LINKS = "node long, other long, n long"
_UNIT = "size int, unit long, tree binary"
_DEALT = "size int, one long, two long, tree binary"


def _write(tree: CoverTree, node: np.ndarray, copies: np.ndarray) -> bytes:
    sizes = np.array([*tree.x.shape, len(tree.lo)], np.int64)
    return b"".join(v.tobytes() for v in (sizes, tree.x, tree.lo, tree.hi, tree.depth, tree.radius, node, copies))


def _read(raw: bytes) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    n, dim, nodes = np.frombuffer(raw, np.int64, 3).tolist()
    at, out = 24, []
    for count, kind in ((n * dim, np.float64), (nodes, np.int64), (nodes, np.int64), (nodes, np.int64), (nodes, np.float64), (n, np.int64), (n, np.int64)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += 8 * count
    tree = object.__new__(CoverTree)
    tree.x, tree.order = out[0].reshape(n, dim), np.arange(n)
    tree.lo, tree.hi, tree.depth, tree.radius = out[1:5]
    tree._ready()
    return tree, out[5], out[6]


def _task(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        sides = [_read(raw) for raw in table.column("tree").to_pylist()]
        own = table.column("one")[0].as_py() == table.column("two")[0].as_py()
        nodes, copies = (np.concatenate([s[k] for s in sides]) for k in (1, 2))
        forest, count = _Forest(len(nodes)), np.zeros(len(nodes), np.int64)
        if own or len(sides) == 2:
            shift = 0 if own else len(sides[0][1])

            def linked(p, q, near, both):
                q = q + shift
                count[p] += near @ copies[q]
                if both:
                    count[q] += copies[p] @ near
                r, c = _labels(near)
                forest.join(np.r_[r[r >= 0], c[c >= 0]], np.r_[p[r >= 0], q[c >= 0]])

            def all_linked(p, q, both):
                q = q + shift
                count[p] += copies[q].sum() - (0 if both else copies[p])
                if both:
                    count[q] += copies[p].sum()
                forest.join(np.zeros(len(p) + len(q), np.int64), np.r_[p, q])

            dual_links(sides[0][0], sides[0 if own else 1][0], cosine, linked, all_linked)
        found = np.flatnonzero(count)
        roots = np.array([forest.root(i) for i in found.tolist()], np.int64)
        return pa.table({"node": nodes[found], "other": nodes[roots], "n": count[found]}, schema=pa.schema([("node", pa.int64()), ("other", pa.int64()), ("n", pa.int64())]))

    return run


def _unit_vectors(column: pa.Array) -> list[np.ndarray]:
    """Each vector as doubles of length one."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        v = flat[i:j] / np.abs(flat[i:j]).max()  # so that squares neither overflow nor vanish
        out.append(v / np.sqrt(v @ v))
    return out


def _cells(centres: dict[int, np.ndarray]):
    """Nearest centre of each vector whose length has several, and the chord to it."""

    def run(batches):
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            cell, gap = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            units = _unit_vectors(batch.column("vector"))
            for size in set(sizes.tolist()) & set(centres):
                rows = np.flatnonzero(sizes == size)
                d = _chords(np.stack([units[r] for r in rows]), centres[size])
                cell[rows], gap[rows] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(cell), pa.array(gap)], names=[*batch.schema.names, "size", "cell", "gap"])

    return run


def _build(table: pa.Table) -> pa.Table:
    """The tree of a unit."""
    size, unit = table.column("size")[0], table.column("unit")[0]
    tree = CoverTree(np.stack(_unit_vectors(table.column("vector").combine_chunks())))
    node, copies = (table.column(c).to_numpy()[tree.order] for c in ("node", "copies"))
    return pa.table({"size": pa.array([size.as_py()], pa.int32()), "unit": pa.array([unit.as_py()], pa.int64()), "tree": pa.array([_write(tree, node, copies)], pa.binary())})


def _deal(tops: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], reach: float):
    """A unit's nodes to every task where they may link. tops: centres and radii of the cells, and each unit's cell."""

    def run(batches):
        for batch in batches:
            for size, unit, raw in zip(*(batch.column(c).to_pylist() for c in ("size", "unit", "tree")), strict=True):
                yield _row(size, unit, unit, raw)
                if size not in tops:
                    continue
                centres, radius, cell_of = tops[size]
                tree, node, copies = _read(raw)
                front, own = tree.front(), cell_of[unit]
                z, r = tree.x[tree.lo[front]], tree.radius[front]
                d = _chords(z, centres)
                plane = _chords(centres[own][None, :], centres)[0]
                with np.errstate(divide="ignore", invalid="ignore"):
                    margin = np.where(plane > 1e-3, (d**2 - d[:, own][:, None] ** 2) / (2 * plane), -np.inf)
                may = (d <= r[:, None] + radius + reach + SLACK) & (margin <= r[:, None] + reach + SLACK)
                for other in range(len(cell_of)):
                    take = np.flatnonzero(may[:, cell_of[other]])
                    if other != unit and len(take):
                        part, rows = tree.part(front[take])
                        yield _row(size, min(unit, other), max(unit, other), _write(part, node[rows], copies[rows]))

    return run


def _row(size: int, one: int, two: int, raw: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([one], pa.int64()), pa.array([two], pa.int64()), pa.array([raw], pa.binary())], names=["size", "one", "two", "tree"])


def _top(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the finest whole level of the top tree that has at most `cells` nodes, filled up from the next."""
    picks, near = [0], _chords(sample, sample[:1])[:, 0]
    while len(picks) < min(cells, len(sample)) and near.max() > SLACK:
        new = int(near.argmax())
        picks.append(new)
        near = np.minimum(near, _chords(sample, sample[new][None, :])[:, 0])
    return sample[picks]


def _numbered(number: dict[int, np.ndarray], parts: dict[int, np.ndarray]):
    """Unit of each vector: the first of its cell, and which of its parts."""

    def run(batches):
        for batch in batches:
            size, cell, node = (batch.column(c).to_numpy() for c in ("size", "cell", "node"))
            unit = np.zeros(len(size), np.int64)
            for s in set(size.tolist()) & set(number):
                rows = np.flatnonzero(size == s)
                drawn = (node[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                unit[rows] = number[s][cell[rows]] + (drawn % parts[s][cell[rows]].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("size", "node", "copies", "vector")), pa.array(unit)], names=["size", "node", "copies", "vector", "unit"])

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", unit_rows: int | None = None, most_cells: int = 16_384) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (vec_id = component_id).

    Links join vectors of equal length whose cosine, in double precision, is at least `cosine`. A
    vector that is null, empty, all zero or holds null or non-finite components links with nothing
    and is its own component. Exact copies are one node that counts its copies. Null ids come first
    and are null as a component id; rows that repeat an id are vectors of their own. Vectors may have
    any number of lengths. Other columns are not read; an empty table gives an empty result.

    unit_rows: vectors of a unit, by default so many that there are a few tasks for each shuffle
    partition, 2,048 to 16,384. Cell centres, up to most_cells, are chosen from a sample of four for each (the bound on
    what is gathered); every vector is dealt and every pair decided.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    x = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    sound = "vector is not null and size(vector) > 0 and forall(vector, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(vector, c -> c <> 0)"
    good = x.withColumn("good", F.coalesce(F.expr(sound), F.lit(False)))
    nodes = good.where("good").groupBy("vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).select(F.monotonically_increasing_id().alias("node"), "first", "copies", "vector")
    nodes = checkpointed(nodes)
    reach = float(np.sqrt(2 - 2 * cosine))
    counts = nodes.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    if unit_rows is None:
        n = counts.agg(F.max("n")).first()[0] or 0
        unit_rows = min(16_384, max(2048, -(-n // math.ceil(math.sqrt(2 * partitions(vectors.sparkSession))))))
    centres: dict[int, np.ndarray] = {}
    many = {r["size"]: r["n"] for r in counts.where(F.col("n") > unit_rows).collect()}  # lengths with several units
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    for size, n in many.items():
        cells = min(most_cells, -(-n // unit_rows))
        rows = max(1024, 4 * cells)
        drawn = nodes.where(F.size("vector") == size).where(share < rows / n).limit(2 * rows).select("vector").toArrow().column("vector").combine_chunks()
        if len(drawn):
            centres[size] = _top(np.stack(_unit_vectors(drawn)), cells)
        else:
            centres[size] = np.eye(1, size)
    placed = nodes.select("node", "copies", "vector").mapInArrow(lean(_cells(centres)), f"node long, copies long, vector {kind}, size int, cell int, gap double")
    number, parts, tops = {}, {}, {}
    facts = {(r["size"], r["cell"]): r for r in placed.where(F.col("size").isin(list(many))).groupBy("size", "cell").agg(F.max("gap").alias("gap"), F.count(F.lit(1)).alias("n")).collect()} if many else {}  # a row a cell
    for size, c in centres.items():
        held = [facts.get((size, k)) for k in range(len(c))]
        parts[size] = np.array([1 if h is None else -(-h["n"] // (2 * unit_rows)) for h in held])
        number[size] = np.cumsum(parts[size]) - parts[size]
        tops[size] = c, np.array([-np.inf if h is None else h["gap"] for h in held]), np.repeat(np.arange(len(c)), parts[size])
    trees = placed.mapInArrow(lean(_numbered(number, parts)), f"size int, node long, copies long, vector {kind}, unit long").groupBy("size", "unit").applyInArrow(lean(_build), _UNIT)
    tasks = trees.mapInArrow(lean(_deal(tops, reach)), _DEALT)
    links = checkpointed(tasks.groupBy("size", "one", "two").applyInArrow(lean(_task(cosine)), _LINKS))
    found = connected_components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    totals = links.groupBy("node").agg(F.sum("n").alias("n"))
    named = checkpointed(nodes.join(found, "node", "left").join(totals, "node", "left").select("vector", "first", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("n", F.lit(0)).alias("n")))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = join_spread(named, least, "component").select("vector", "least", (F.col("n") + F.col("copies") - 1).alias("links"))
    linked = good.where("good").select("id", "vector").join(named, "vector").select("id", "links", "least")
    alone = good.where("not good").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("least"))
    out = linked.unionByName(alone)
    return out.select(outer_id().alias(id_col), F.col("links").alias("n_links"), outer_id("least").alias("component_id"), (F.col("id") == F.col("least")).alias("kept"))
