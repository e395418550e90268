"""Attention over time: daily counts, intensity after an event, and its decay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import spread_by


def daily_counts(mentions: DataFrame, posts: DataFrame, entity: str = "entity_id", post: str = "post_id", time: str = "timestamp_utc") -> DataFrame:
    """(entity, date, mention_count, total_posts): mentions by day, beside all posts of that day."""
    dated = posts.select(post, F.col(time).cast("date").alias("date"))
    totals = dated.groupBy("date").agg(F.count(F.lit(1)).alias("total_posts"))
    daily = mentions.select(entity, post).join(dated, post).groupBy(entity, "date").agg(F.count(F.lit(1)).alias("mention_count"))
    return daily.join(totals, "date", "left").select(entity, "date", "mention_count", "total_posts")


def intensity(daily: DataFrame, cases: DataFrame, entity: str = "entity_id", event: str = "event_date", start: int = 0, end: int = 7) -> DataFrame:
    """Share of an entity's mentions in all posts from event + start to event + end, both included; one row a dated case."""
    dated = cases.where(F.col(event).isNotNull()).select(entity, F.col(event).cast("date").alias("_event"))
    inside = daily.select(F.col(entity).alias("_entity"), "date", "mention_count", "total_posts")
    joined = dated.join(inside, (F.col(entity) == F.col("_entity")) & F.col("date").between(F.date_add("_event", start), F.date_add("_event", end)), "left")
    sums = joined.groupBy(entity, "_event").agg(F.coalesce(F.sum("mention_count"), F.lit(0)).alias("mentions_immediate"), F.coalesce(F.sum("total_posts"), F.lit(0)).alias("total_posts_immediate"))
    share = F.when(F.col("total_posts_immediate") > 0, F.col("mentions_immediate") / F.col("total_posts_immediate")).otherwise(0.0)
    return sums.select(entity, share.alias("intensity"), "mentions_immediate", "total_posts_immediate")


def power_law(tau, c, alpha):
    return c * np.asarray(tau, float) ** -alpha


def fit_power_law(tau: np.ndarray, y: np.ndarray, low: float = 0.01, high: float = 10.0) -> tuple[float, float, float]:
    """(C, alpha, standard error of alpha) of y = C * tau**-alpha by least squares, C >= 0, alpha in [low, high].

    For a given alpha the best C is known, so alpha alone is searched: on a grid, then three times on 41 points between
    the neighbours of the best, which leaves it within 1e-6 up to alpha 3 and 3e-6 beyond.
    """
    t = np.log(tau)
    total = float(y @ y)

    def errors(alphas):
        f = np.exp(-alphas[:, None] * t)
        own, cross = (f * f).sum(axis=1), f @ y
        c = np.maximum(0, cross) / own
        return total - 2 * c * cross + c * c * own, c

    grid = np.r_[np.linspace(low, 3, 300), np.linspace(3.05, high, 140)]
    for level in range(4):
        error, c = errors(grid)
        k = int(error.argmin())
        if level < 3:
            grid = np.linspace(grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)], 41)
    alpha, best_c = float(grid[k]), float(c[k])
    f = np.exp(-alpha * t)
    ff, ft, tt = float(f @ f), float((t * f) @ f) * best_c, float((t * f) @ (t * f)) * best_c**2
    free, plane = len(y) - 2, ff * tt - ft * ft
    left = float(((y - best_c * f) ** 2).sum())
    return best_c, alpha, float(np.sqrt(left / free * ff / plane)) if free > 0 and plane > 0 else float("inf")


DECAY = "longevity double, alpha double, alpha_se double, C double, n_days int, fit_success boolean"


def fit_decay(daily: DataFrame, cases: DataFrame, entity: str = "entity_id", event: str = "event_date", end: int = 730, least: int = 5) -> DataFrame:
    """Decay of mentions after the event, one row a dated case: longevity is 1 / alpha, null where too few days remain."""
    return _fitted(daily, cases, entity, event, end, least, None)


def _fitted(daily: DataFrame, cases: DataFrame, entity: str, event: str, end: int, least: int, window: tuple[int, int] | None) -> DataFrame:
    """fit_decay's rows; window: also the mentions and posts of days from window[0] to window[1] after the event, from the same join."""
    dated = cases.where(F.col(event).isNotNull()).select(entity, F.col(event).cast("date").alias("_event"))
    joined = dated.join(daily, entity, "left").select(entity, F.datediff("date", "_event").cast("double").alias("tau"), F.col("mention_count").cast("double").alias("y"), F.col("total_posts").cast("double").alias("total"))
    kind = dated.schema[entity].dataType.simpleString()

    more = ["mentions_immediate", "total_posts_immediate"] if window is not None else []
    shape = [*more, "longevity", "alpha", "alpha_se", "C", "n_days", "fit_success"]
    types = [*[pa.int64() for _ in more], pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.bool_()]

    def fit(rows: pa.Table) -> pa.Table:
        tau, y, total = (rows.column(c).to_numpy().astype(np.float64) for c in ("tau", "y", "total"))  # a null is not a number
        sums = []
        if window is not None:
            inside = (tau >= window[0]) & (tau <= window[1])
            sums = [int(np.nansum(y[inside])), int(np.nansum(total[inside]))]
        keep = (tau > 0) & ~np.isnan(y)
        if keep.sum() >= least and (keep & (y > 0)).sum() >= least:
            keep &= (y > 0) & (tau <= end)
            least_left = 3
        else:
            keep, least_left = (keep & (y > 0) if keep.sum() >= least else keep), np.inf
        n, found = int(keep.sum()), (None, None, None)
        if n >= least_left:
            order = np.argsort(tau[keep], kind="stable")
            found = fit_power_law(tau[keep][order], y[keep][order])
        c, alpha, error = found
        values = [*sums, 1 / alpha if alpha else None, alpha, error, c, n, alpha is not None]
        return pa.table({entity: rows.column(entity).slice(0, 1), **{k: pa.array([v], t) for k, v, t in zip(shape, values, types, strict=True)}})

    wanted = f"{entity} {kind}, " + "".join(f"{c} long, " for c in more) + DECAY
    return spread_by(joined, entity).applyInArrow(fit, wanted)


def temporal_metrics(mentions: DataFrame, posts: DataFrame, cases: DataFrame, entity: str = "entity_id", event: str = "event_date", start: int = 0, immediate: int = 7, end: int = 730, least: int = 5, **names) -> DataFrame:
    """Intensity and decay of every dated case, in one table and from one join; a case is one row."""
    found = _fitted(daily_counts(mentions, posts, entity, **names), cases, entity, event, end, least, (start, immediate))
    share = F.when(F.col("total_posts_immediate") > 0, F.col("mentions_immediate") / F.col("total_posts_immediate")).otherwise(0.0)
    return found.select(entity, share.alias("intensity"), "mentions_immediate", "total_posts_immediate", "longevity", "alpha", "alpha_se", "C", "n_days", "fit_success")


def decay_points(daily: DataFrame, fits: DataFrame, cases: DataFrame, entity: str = "entity_id", event: str = "event_date", end: int = 730) -> DataFrame:
    """(entity, tau, mention_count, fitted): the observed days of each fitted case, 1 to `end` days after its event, beside the curve."""
    dated = cases.where(F.col(event).isNotNull()).select(entity, F.col(event).cast("date").alias("_event"))
    held = fits.where("fit_success").select(entity, "C", "alpha").join(dated, entity)
    x = daily.join(held, entity).select(entity, F.datediff("date", "_event").alias("tau"), "mention_count", "C", "alpha").where(F.col("tau").between(1, end))
    return x.select(entity, "tau", "mention_count", (F.col("C") * F.pow(F.col("tau").cast("double"), -F.col("alpha"))).alias("fitted"))


def decay_curve(fits: DataFrame, entity: str = "entity_id", points: int = 200, end: int = 730) -> DataFrame:
    """Points of each fitted curve, for figures."""
    tau = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: 1 + k * F.lit((end - 1) / (points - 1))))
    x = fits.where("fit_success").select(entity, "C", "alpha", tau.alias("tau"))
    return x.select(entity, "tau", (F.col("C") * F.pow("tau", -F.col("alpha"))).alias("fitted"))
