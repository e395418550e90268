"""Convergence and drift of an entity's posts in embedding space."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import cosine_distance, dot, unit

from .relational import sample_per_key, spread_by

SIMILARITY = "similarity_median double, similarity_iqr double, similarity_mean double, similarity_std double, n long"


def pair_stats(x: np.ndarray, most: int = 50_000_000, bins: int = 1 << 16, block: int = 1024) -> tuple[np.ndarray, float, float]:
    """(quartiles, mean, deviation) of the dot products of all pairs of rows, exactly: in blocks, no more than about `most` values at once.

    Beyond `most` pairs each pass counts the values of finer bins around the wanted ranks, until few are left to sort.
    """
    n = len(x)
    pairs = n * (n - 1) // 2

    def values():
        for a in range(0, n, block):
            for b in range(a, n, block):
                s = x[a : a + block] @ x[b : b + block].T
                yield s[np.triu_indices(len(s), 1)] if a == b else s.ravel()

    if pairs <= most:
        s = np.concatenate(list(values()))
        return np.percentile(s, [25, 50, 75]), float(s.mean()), float(s.std())
    low, high, total = np.inf, -np.inf, 0.0
    for s in values():
        if len(s):
            low, high, total = min(low, s.min()), max(high, s.max()), total + s.sum()
    mean = total / pairs
    square = sum(float(((s - mean) ** 2).sum()) for s in values())
    places = [q * (pairs - 1) for q in (0.25, 0.5, 0.75)]
    found: dict[int, float] = {}

    def search(lo: float, hi: float, before: int, ranks: list[int]) -> None:
        """Finds the values of these ranks, which lie from lo to hi; `before` values are smaller than lo."""
        if lo == hi:
            found.update(dict.fromkeys(ranks, float(lo)))
            return

        def bin_of(s):  # ascends with the value
            return np.minimum((s - lo) / (hi - lo) * bins, bins - 1).astype(np.int64)

        counts = np.zeros(bins, np.int64)
        for s in values():
            counts += np.bincount(bin_of(s[(s >= lo) & (s <= hi)]), minlength=bins)
        ends = before + np.cumsum(counts)
        wanted = np.searchsorted(ends, ranks, "right")
        for k in np.unique(wanted).tolist():
            own, start = [r for r, w in zip(ranks, wanted, strict=True) if w == k], int(ends[k] - counts[k])
            if counts[k] <= most:
                inside = (s[(s >= lo) & (s <= hi)] for s in values())
                few = np.sort(np.concatenate([s[bin_of(s) == k] for s in inside]))
                found.update({r: float(few[r - start]) for r in own})
                continue
            least, greatest = np.inf, -np.inf
            for s in values():
                s = s[(s >= lo) & (s <= hi)]
                s = s[bin_of(s) == k]
                if len(s):
                    least, greatest = min(least, s.min()), max(greatest, s.max())
            search(least, greatest, start, own)

    search(low, high, 0, sorted({r for x in places for r in (int(x), min(int(x) + 1, pairs - 1))}))
    quartiles = [found[int(x)] + (x - int(x)) * (found[min(int(x) + 1, pairs - 1)] - found[int(x)]) for x in places]
    return np.array(quartiles), mean, float(np.sqrt(square / pairs))


def similarity_stats(vectors: DataFrame, entity: str, id_col: str, vector: str, sample: int | None = 10_000, seed: int = 42) -> DataFrame:
    """Median, interquartile range, mean and deviation of the pairwise dot products of up to `sample` vectors an entity, all if None; zeros for one vector.

    An entity's pairs are one task's work.
    """
    kind = vectors.schema[entity].dataType.simpleString()

    def stats(key, rows):
        x = np.stack(rows[vector].to_numpy()).astype(np.float64)
        n = len(x)
        values = np.zeros(4)
        if n > 1:
            q, mean, deviation = pair_stats(x)
            values = np.array([q[1], q[2] - q[0], mean, deviation])
        return pd.DataFrame([[key[0], *values, n]], columns=[entity, "similarity_median", "similarity_iqr", "similarity_mean", "similarity_std", "n"])

    some = sample_per_key(vectors.where(F.col(vector).isNotNull()), entity, id_col, sample, seed)
    return spread_by(some.select(entity, vector), entity).applyInPandas(stats, f"{entity} {kind}, {SIMILARITY}")


def unigram_entropy(posts: DataFrame, entity: str, text: str) -> DataFrame:
    """(entity, entropy) in bits over words of three characters or more; entities without words have 0."""
    counts = posts.select(entity, F.explode(T.tokens(F.col(text), 3)).alias("w")).groupBy(entity, "w").agg(F.count(F.lit(1)).alias("n"))
    # sum(-p log p) = log N - sum(n log n) / N
    sums = counts.groupBy(entity).agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    found = sums.select(entity, (F.log2(F.col("N").cast("double")) - F.col("s") / F.col("N")).alias("entropy"))
    return posts.select(entity).distinct().join(found, entity, "left").select(entity, F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def density_clusters(x: np.ndarray, least: int = 15) -> np.ndarray:
    """Labels of density clusters, -1 for noise: spanning tree of mutual reachability, condensed, clusters of most excess mass."""
    n = len(x)
    square = (x * x).sum(axis=1)

    def gaps(rows):
        return np.sqrt(np.maximum(0, square[rows][:, None] + square[None, :] - 2 * (x[rows] @ x.T)))

    # distances are made when they are needed: memory grows with n, not with its square
    step = max(1, 4_000_000 // n)
    k = min(least, n) - 1
    core = np.concatenate([np.partition(gaps(np.arange(a, min(a + step, n))), k, axis=1)[:, k].copy() for a in range(0, n, step)])  # a view would keep all distances
    # minimum spanning tree
    inside, best, via = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, np.int64)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(gaps(np.array([at]))[0], np.maximum(core, core[at]))
        closer = (reach < best) & ~inside
        best[closer], via[closer] = reach[closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[at], via[at], at))
    edges.sort()
    # single-linkage merges: node ids from n up
    up, node, size = list(range(n)), list(range(n)), [1] * n
    merges: list[tuple[int, int, float]] = []

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for d, a, b in edges:
        a, b = root(int(a)), root(int(b))
        merges.append((node[a], node[b], d))
        up[b] = a
        size.append(size[node[a]] + size[node[b]])
        node[a] = n + len(merges) - 1

    def leaves(k):
        out, stack = [], [k]
        while stack:
            j = stack.pop()
            if j < n:
                out.append(j)
            else:
                stack += merges[j - n][:2]
        return out

    # condense: a split counts only where both sides have `least` points
    clusters = [{"birth": 0.0, "mass": 0.0, "children": [], "node": n + len(merges) - 1 if merges else 0}]
    todo = [(n + len(merges) - 1, 0)] if merges else []
    while todo:
        k, c = todo.pop()
        while k >= n:
            a, b, d = merges[k - n]
            density = 1 / d if d > 0 else np.inf
            big = [j for j in (a, b) if size[j] >= least]
            gain = min(density, 1e12) - clusters[c]["birth"]
            if len(big) == 2:
                clusters[c]["mass"] += gain * size[k]
                for j in big:
                    clusters.append({"birth": min(density, 1e12), "mass": 0.0, "children": [], "node": j})
                    clusters[c]["children"].append(len(clusters) - 1)
                    todo.append((j, len(clusters) - 1))
                break
            fallen = size[k] - sum(size[j] for j in big)
            clusters[c]["mass"] += gain * fallen
            if not big:
                break
            k = big[0]
    chosen: set[int] = set()
    total = [0.0] * len(clusters)
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(total[j] for j in clusters[c]["children"])
        if c == 0 or (clusters[c]["children"] and below > clusters[c]["mass"]):
            total[c] = below
        else:
            total[c] = clusters[c]["mass"]
            stack = list(clusters[c]["children"])
            while stack:
                j = stack.pop()
                chosen.discard(j)
                stack += clusters[j]["children"]
            chosen.add(c)
    labels = np.full(n, -1)
    for k, c in enumerate(sorted(chosen)):
        labels[leaves(clusters[c]["node"])] = k  # chosen ones share no points
    return labels


def topic_concentration(vectors: DataFrame, entity: str, id_col: str, vector: str, least: int = 15, sample: int | None = None, seed: int = 42) -> DataFrame:
    """(entity, n_clusters, top3_proportion, noise_proportion) of all vectors of an entity, or of `sample` of them; (0, 0, 1) below twice the least cluster.

    An entity is one task's work: its vectors in memory, time with their square.
    """
    kind = vectors.schema[entity].dataType.simpleString()

    def cluster(key, rows):
        answer = (0, 0.0, 1.0)
        if len(rows) >= 2 * least:
            labels = density_clusters(np.stack(rows.sort_values(id_col)[vector].to_numpy()).astype(np.float64), least)
            counts = np.sort(np.bincount(labels[labels >= 0]))[::-1] if (labels >= 0).any() else np.zeros(0)
            kept = counts.sum()
            answer = (int((counts > 0).sum()), float(counts[:3].sum() / kept) if kept else 0.0, float((labels < 0).mean()))
        return pd.DataFrame([[key[0], *answer]], columns=[entity, "n_clusters", "top3_proportion", "noise_proportion"])

    some = sample_per_key(vectors.where(F.col(vector).isNotNull()), entity, id_col, sample, seed)
    return spread_by(some.select(entity, id_col, vector), entity).applyInPandas(cluster, f"{entity} {kind}, n_clusters int, top3_proportion double, noise_proportion double")


def semantic_metrics(posts: DataFrame, entity: str, id_col: str, vector: str, text: str, least_posts: int = 5, **options) -> DataFrame:
    """Similarity, clusters and entropy of every entity with least_posts posts or more."""
    enough = posts.join(posts.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_posts).select(entity), entity, "left_semi")
    return similarity_stats(enough, entity, id_col, vector, **options).join(topic_concentration(enough, entity, id_col, vector), entity).join(unigram_entropy(enough, entity, text), entity)


def drift_windows(posts: DataFrame, dim: int, entity: str = "entity_id", id_col: str = "post_id", vector: str = "embedding", days: str = "days", window_days: int = 30, end: int = 730, least_posts: int = 5, window_sample: int | None = 2000, seed: int = 42) -> DataFrame:
    """(entity, window, n_posts, centroid_drift, dispersion, dispersion_std, evasion_rate, cumulative_drift).

    days: days since the entity's event. Windows start before `end`, the last may pass it; windows of
    fewer than two posts are left out, and drift is against the last window that was not. Up to
    window_sample posts of a window are used, all if None.
    """
    windows = -(-end // window_days)
    enough = posts.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_posts).select(entity)
    inside = posts.join(enough, entity, "left_semi").withColumn("window", F.floor(F.col(days) / window_days).cast("int")).where(f"window >= 0 and window < {windows}")
    some = sample_per_key(inside, [entity, "window"], id_col, window_sample, seed).select(entity, "window", F.col(vector).alias("v"))
    means = [F.avg(F.col("v")[i].cast("double")).alias(f"m{i}") for i in range(dim)]
    centres = some.groupBy(entity, "window").agg(*means, F.count(F.lit(1)).alias("n_posts")).where("n_posts >= 2").select(entity, "window", "n_posts", unit(F.array(*[f"m{i}" for i in range(dim)])).alias("centroid"))
    order = Window.partitionBy(entity).orderBy("window")
    before = F.lag("centroid").over(order)
    centres = centres.withColumn("centroid_drift", F.when(before.isNull(), 0.0).otherwise(cosine_distance(F.col("centroid"), before)))
    centres = centres.withColumn("canonical", F.first("centroid").over(order)).withColumn("first_window", F.first("window").over(order)).withColumn("cumulative_drift", F.sum("centroid_drift").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spread = some.join(centres, [entity, "window"]).select(entity, "window", "n_posts", "centroid_drift", "cumulative_drift", "first_window", (1 - dot(F.col("v"), F.col("centroid"))).alias("own"), (1 - dot(F.col("v"), F.col("canonical"))).alias("far"))
    usual = spread.where("window = first_window").groupBy(entity).agg(F.median("far").alias("usual"))
    local = spread.groupBy(entity, "window").agg(F.median("far").alias("here"))
    limits = local.join(usual, entity).select(entity, "window", (2 * F.when(F.col("usual") > 1e-6, F.col("usual")).otherwise(F.col("here"))).alias("limit"))
    joined = spread.join(limits, [entity, "window"])
    out = joined.groupBy(entity, "window", "n_posts", "centroid_drift", "cumulative_drift").agg(F.avg("own").alias("dispersion"), F.stddev_pop("own").alias("dispersion_std"), F.avg(F.when((F.col("limit") > 0) & (F.col("far") > F.col("limit")), 1.0).otherwise(0.0)).alias("evasion_rate"))
    return out.select(entity, "window", "n_posts", "centroid_drift", "dispersion", "dispersion_std", "evasion_rate", "cumulative_drift")


def mention_days(mentions: DataFrame, posts: DataFrame, vectors: DataFrame, cases: DataFrame, entity: str = "entity_id", post: str = "post_id", time: str = "timestamp_utc", vector: str = "embedding", event: str = "event_date") -> DataFrame:
    """(entity, post, days, embedding): the mentions of dated cases whose post is known and has a vector, with the days since the event; what drift_windows takes."""
    dated = cases.where(F.col(event).isNotNull()).select(entity, F.col(event).cast("date").alias("_event"))
    held = mentions.select(entity, post).distinct().join(dated, entity).join(posts.select(post, F.col(time).cast("date").alias("_date")), post)
    return held.select(entity, post, F.datediff("_date", "_event").alias("days")).join(vectors.select(post, vector), post).where(F.col(vector).isNotNull())


def drift_summary(windows: DataFrame, entity: str = "entity_id") -> DataFrame:
    """One row an entity with two windows or more; dispersion_trend is the slope of dispersion over the windows' order."""
    numbered = windows.withColumn("_i", F.row_number().over(Window.partitionBy(entity).orderBy("window")) - 1)
    sums = numbered.groupBy(entity).agg(F.avg("centroid_drift").alias("mean_drift"), F.max("centroid_drift").alias("max_drift"), F.max_by("cumulative_drift", "window").alias("final_cumulative_drift"), F.avg("dispersion").alias("mean_dispersion"), F.coalesce(F.regr_slope("dispersion", "_i"), F.lit(0.0)).alias("dispersion_trend"), F.avg("evasion_rate").alias("mean_evasion_rate"), F.count(F.lit(1)).alias("n_windows"))
    return sums.where("n_windows >= 2")
