"""Fusing affect, attention and convergence into scores, and regressing them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import min_max, z_score
from ..session import scratch_folder
from .relational import spread_by

INDICATORS = ("intensity", "longevity", "similarity_median", "positive_ratio", "log_volume")


def affect_ratios(mentions: DataFrame, affect: DataFrame, entity: str = "entity_id", post: str = "post_id", label: str = "label") -> DataFrame:
    """(entity, n_positive, n_negative, n_total, positive_ratio, negative_ratio)."""
    joined = mentions.select(entity, post).join(affect.select(post, label), post)
    sums = joined.groupBy(entity).agg(F.count_if(F.col(label) == "positive").alias("n_positive"), F.count_if(F.col(label) == "negative").alias("n_negative"), F.count(F.lit(1)).alias("n_total"))
    return sums.select("*", (F.col("n_positive") / F.col("n_total")).alias("positive_ratio"), (F.col("n_negative") / F.col("n_total")).alias("negative_ratio"))


def naive_score(affect: DataFrame, temporal: DataFrame, semantic: DataFrame, entity: str = "entity_id", epsilon: float = 1e-6) -> DataFrame:
    """z(log affect ratio) * (scaled intensity + longevity + similarity). Entities of any of the three tables; gaps are 0, ratios 0.5."""
    x = affect.join(temporal.select(entity, "intensity", "longevity"), entity, "full").join(semantic.select(entity, "similarity_median"), entity, "full")
    x = x.na.fill({"intensity": 0.0, "longevity": 0.0, "similarity_median": 0.0, "positive_ratio": 0.5, "negative_ratio": 0.5})
    x = x.withColumn("log_affect_ratio", F.log(F.col("positive_ratio") + epsilon) - F.log(F.col("negative_ratio") + epsilon))
    scaled = ("intensity", "longevity", "similarity_median")
    # one row of statistics, joined to every row
    stats = x.agg(F.avg("log_affect_ratio").alias("_mean"), F.stddev_samp("log_affect_ratio").alias("_std"), *[f(c).alias(f"_{k}_{c}") for c in scaled for k, f in (("min", F.min), ("max", F.max))])
    x = x.crossJoin(F.broadcast(stats)).withColumn("z_affect", z_score(F.col("log_affect_ratio"), F.col("_mean"), F.col("_std")))
    x = x.withColumns({f"{c}_scaled": min_max(F.col(c), F.col(f"_min_{c}"), F.col(f"_max_{c}")) for c in scaled}).drop(*stats.columns)
    return x.withColumn("score_naive", F.col("z_affect") * sum((F.col(f"{c}_scaled") for c in scaled), F.lit(0.0)))


def factor_features(affect: DataFrame, temporal: DataFrame, semantic: DataFrame, volume: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(entity, z_* of five indicators): gaps are 0, deviations are those of the population."""
    x = affect.select(entity, "positive_ratio").join(temporal.select(entity, "intensity", "longevity"), entity, "full").join(semantic.select(entity, "similarity_median"), entity, "full").join(volume.select(entity, "volume"), entity, "full").na.fill(0.0, ["positive_ratio", "intensity", "longevity", "similarity_median"]).na.fill(0, ["volume"])
    x = x.withColumn("log_volume", F.log1p(F.col("volume").cast("double")))
    stats = x.agg(*[f(c).alias(f"_{k}_{c}") for c in INDICATORS for k, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return x.crossJoin(F.broadcast(stats)).select(entity, *[z_score(F.col(c), F.col(f"_mean_{c}"), F.col(f"_std_{c}")).alias(f"z_{c}") for c in INDICATORS])


def compared_scores(naive: DataFrame, bayes: DataFrame, members: DataFrame | None = None, entity: str = "entity_id", ranked: int | None = None, by: str = "score_bayes") -> DataFrame:
    """Naive beside Bayesian scores, for figures.

    Without `ranked`, entities that have both, and no null among them; with it, the `ranked` highest by
    `by` of all naive rows, with a rank from 1 (ties by id), nulls last. members: keep only its entities. Of two columns of one name the
    Bayesian table's is left out.
    """
    if members is not None:
        naive = naive.join(members.select(entity).distinct(), entity, "left_semi")
    extra = bayes.select(entity, *[c for c in bayes.columns if c not in naive.columns])
    if ranked is None:
        return naive.join(extra, entity).dropna(subset=["score_naive", "score_bayes"])
    # a top list: each task keeps its first rows, so the one task that numbers them gets few
    top = naive.join(extra, entity, "left").orderBy(F.col(by).desc_nulls_last(), entity).limit(ranked)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc_nulls_last(), entity)))


def hdi(draws: np.ndarray, prob: float = 0.89) -> tuple[float, float]:
    """The narrowest interval that holds `prob` of the draws."""
    x = np.sort(np.asarray(draws, float))
    k = int(np.floor(prob * len(x)))
    if k >= len(x):
        return float(x[0]), float(x[-1])
    i = int(np.argmin(x[k:] - x[: len(x) - k]))
    return float(x[i]), float(x[i + k])


def hdi_per_key(draws: DataFrame, key: str, value: str, prob: float = 0.89) -> DataFrame:
    """(key, low, high) of the narrowest interval: each draw beside the one `prob` further on, by windows over the sorted draws of a key. Nulls don't count."""
    held = draws.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_low"))
    order = Window.partitionBy(key).orderBy("_low")
    ranked = held.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    k = F.floor(F.lit(prob) * F.col("_n")).cast("int")
    ends = ranked.select(key, (F.col("_i") - k).alias("_i"), F.col("_low").alias("high"))
    last = ranked.groupBy(key).agg(F.max("_low").alias("_top"), F.max("_n").alias("_m"))
    pairs = ranked.join(ends, [key, "_i"]).select(key, "_i", F.col("_low").alias("low"), "high")
    whole = ranked.join(last, key).where((F.col("_i") == 1) & (F.floor(F.lit(prob) * F.col("_m")) >= F.col("_m"))).select(key, "_i", F.col("_low").alias("low"), F.col("_top").alias("high"))
    best = pairs.unionByName(whole).groupBy(key).agg(F.min_by(F.struct("low", "high"), F.struct((F.col("high") - F.col("low")).alias("w"), "_i")).alias("b"))
    return best.select(key, "b.low", "b.high")


def _half_normal_slice(rng, now: float, log_likelihood, scale: float) -> float:
    """One slice step for a positive scale with a half-normal prior."""
    def density(s):
        return -np.inf if s <= 0 else log_likelihood(s) - s * s / (2 * scale * scale)

    level = density(now) - rng.exponential()
    low, width = max(0.0, now - rng.uniform() * scale), scale
    high = low + width
    while density(high) > level:
        high += width
    while low > 0 and density(low) > level:
        low = max(0.0, low - width)
    while True:
        s = rng.uniform(low, high)
        if density(s) > level:
            return s
        if s < now:
            low = s
        else:
            high = s


def _factor_chain(x: np.ndarray, chain: int, samples: int, tune: int, seed: int, positive_loadings: bool, block: int) -> tuple[np.ndarray, np.ndarray]:
    """What a chain's draws can be made from again: (samples, columns + 2) of weights, deviation and sign, and (samples, blocks, 2) of the generator's state before each block of entities.

    Holds a few numbers an entity, not its draws.
    """
    n, m = x.shape
    rng = np.random.default_rng((seed, chain))
    factor, loading, sigma = rng.normal(size=n), np.full(m, 0.5), np.ones(m)
    made, states = np.empty((samples, m + 2)), np.empty((samples, -(-n // block), 2), np.uint64)
    for t in range(tune + samples):
        precision = 1 + (loading**2 / sigma**2).sum()
        weight, deviation, sign = loading / sigma**2, np.sqrt(precision), 1.0
        mean = (x @ weight) / precision
        for k, a in enumerate(range(0, n, block)):
            if t >= tune:
                now = rng.bit_generator.state["state"]["state"]
                states[t - tune, k] = now >> 64, now & (1 << 64) - 1
            part = mean[a : a + block]
            factor[a : a + block] = part + rng.normal(size=len(part)) / deviation
        p = (factor @ factor) / sigma**2 + 1
        loading = ((factor @ x) / sigma**2 + 0.5) / p + rng.normal(size=m) / np.sqrt(p)
        if positive_loadings and loading.sum() < 0:
            factor, loading, sign = -factor, -loading, -1.0
        if t >= tune:
            made[t - tune] = *(weight / precision), 1 / deviation, sign
        rest = sum(((x[a : a + 65_536] - factor[a : a + 65_536, None] * loading) ** 2).sum(axis=0) for a in range(0, n, 65_536))
        sigma = np.array([_half_normal_slice(rng, s, lambda v, r=r: -n * np.log(v) - r / (2 * v * v), 1.0) for s, r in zip(sigma, rest, strict=True)])
    return made, states


def _block_draws(x: np.ndarray, chain: int, seed: int, made: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Draws (sample, entity) of one block of entities in a chain, from _factor_chain's numbers and the block's states."""
    rng = np.random.default_rng((seed, chain))
    start, out = rng.bit_generator.state, np.empty((len(made), len(x)))
    for t, (high, low) in enumerate(states.tolist()):
        start["state"]["state"] = high << 64 | low
        rng.bit_generator.state = start
        out[t] = made[t, -1] * (x @ made[t, :-2] + rng.normal(size=len(x)) * made[t, -2])
    return out


def factor_score(x: np.ndarray, samples: int = 2000, tune: int = 1000, chains: int = 4, seed: int = 42, positive_loadings: bool = False) -> np.ndarray:
    """Draws (chain * sample, entity) of one factor behind the columns of x.

    x[i, j] ~ N(loading_j * factor_i, sigma_j), factor ~ N(0, 1), loading ~ N(0.5, 1), sigma ~ half-normal(1).
    Gibbs steps for factors and loadings, slice steps for the scales. All draws at once, for few entities; bayes_score makes the same in blocks.
    """
    out = []
    for chain in range(chains):
        made, states = _factor_chain(x, chain, samples, tune, seed, positive_loadings, len(x))
        out.append(_block_draws(x, chain, seed, made, states[:, 0]))
    return np.concatenate(out)


MOST_ENTITIES = 1_000_000_000  # rows of a regression, of which the driver holds sums by group
MOST_GATHERED = 10_000_000  # entities whose indicators, 48 bytes each, the driver and each chain hold
BLOCK = 512  # entities whose draws a task holds at once


def _few_enough(n: int, most: int) -> None:
    """Too many are an error, not a sample."""
    if n > most:
        raise ValueError(f"a sampler takes up to {most} entities")


def diagnostics(draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(r_hat, bulk effective sample size) of draws (chains, samples, parameters): rank-normalised, chains split in halves."""
    chains, samples, m = draws.shape
    half = samples // 2
    x = np.concatenate([draws[:, :half], draws[:, half : 2 * half]])
    n, c = half, 2 * chains
    normal, quantile = np.empty_like(x), _normal_quantile((np.arange(1.0, c * n + 1) - 0.375) / (c * n + 0.25))
    for k in range(m):
        rank = np.argsort(np.argsort(x[:, :, k].ravel(), kind="stable"), kind="stable")
        normal[:, :, k] = quantile[rank].reshape(c, n)
    within, mean = normal.var(axis=1, ddof=1).mean(axis=0), normal.mean(axis=1)
    total = within * (n - 1) / n + mean.var(axis=0, ddof=1)
    r_hat = np.sqrt(total / within)
    centred = normal - mean[:, None]
    size = 1 << (2 * n - 1).bit_length()
    power = np.abs(np.fft.rfft(centred, size, axis=1)) ** 2
    lagged = np.fft.irfft(power, size, axis=1)[:, :n].mean(axis=0) / n
    rho = 1 - (within - lagged * n / (n - 1)) / total
    ess = np.empty(m)
    for k in range(m):  # initial monotone sequence of pair sums
        pairs = rho[: 2 * (n // 2), k].reshape(-1, 2).sum(axis=1)
        end = int(np.argmax(pairs < 0)) if (pairs < 0).any() else len(pairs)
        tau = -1 + 2 * np.minimum.accumulate(pairs[: max(1, end)]).sum()
        ess[k] = c * n / max(tau, 1 / np.log10(max(10, c * n)))
    return r_hat, ess


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.array([NormalDist().inv_cdf(x) for x in p.tolist()])


def _draw_rows(spark, draws: np.ndarray, chains: int, names: list, kind: str, name: str) -> DataFrame:
    """(chain, draw, name, value) of draws (chain * sample, parameter)."""
    import pandas as pd

    each, m = len(draws) // chains, draws.shape[1]
    table = pd.DataFrame({"chain": np.repeat(np.arange(chains), each * m), "draw": np.tile(np.repeat(np.arange(each), m), chains), name: names * len(draws), "value": draws.ravel()})
    return spark.createDataFrame(table, f"chain long, draw long, {name} {kind}, value double")


def bayes_score(features: DataFrame, entity: str = "entity_id", prob: float = 0.89, draws_path: str | None = None, samples: int = 2000, tune: int = 1000, chains: int = 4, seed: int = 42, positive_loadings: bool = False) -> DataFrame:
    """(entity, score_bayes, hdi_low, hdi_high, r_hat, ess_bulk) from factor_features. draws_path: where all draws are written as Parquet.

    The indicators, a row an entity, are gathered on the driver and go to a task for each chain, which keeps the
    generator's states in place of draws. Tasks then make the draws of BLOCK entities at a time again and sum them up.
    """
    import pandas as pd

    spark, kind = features.sparkSession, features.schema[entity].dataType.simpleString()
    rows = features.select(entity, *[f"z_{c}" for c in INDICATORS]).orderBy(entity).limit(MOST_GATHERED + 1).toPandas()
    _few_enough(len(rows), MOST_GATHERED)
    schema = f"{entity} {kind}, score_bayes double, hdi_low double, hdi_high double, r_hat double, ess_bulk double"
    if not len(rows):
        return spark.createDataFrame([], schema)
    block = BLOCK
    shared = spark.sparkContext.broadcast((rows[entity].array, np.ascontiguousarray(rows[[f"z_{c}" for c in INDICATORS]].to_numpy(float))))

    def run(batches):
        for chain in (c for b in batches for c in b["id"].tolist()):
            made, states = _factor_chain(shared.value[1], chain, samples, tune, seed, positive_loadings, block)
            yield pd.DataFrame({"chain": [chain], "block": [-1], "held": [made.tobytes()]})
            for k in range(states.shape[1]):
                yield pd.DataFrame({"chain": [chain], "block": [k], "held": [states[:, k].tobytes()]})

    path = scratch_folder(spark, "chains")
    spark.range(chains, numPartitions=chains).mapInPandas(run, "chain long, block long, held binary").write.parquet(path)
    held = spark.read.parquet(path)
    made = {r["chain"]: np.frombuffer(r["held"]).reshape(samples, -1) for r in held.where("block < 0").collect()}  # a row a chain

    def draws_of(table) -> tuple[list, np.ndarray]:
        """The names of a block's entities and their draws (chain, sample, entity)."""
        names, x = shared.value
        at = int(table["block"].iloc[0]) * block
        states = {c: np.frombuffer(h, np.uint64).reshape(samples, 2) for c, h in zip(table["chain"], table["held"], strict=True)}
        return names[at : at + block], np.stack([_block_draws(x[at : at + block], c, seed, made[c], states[c]) for c in range(chains)])

    def summary(table):
        names, draws = draws_of(table)
        flat, step = draws.reshape(chains * samples, -1), 64
        ends = [hdi(flat[:, i], prob) for i in range(len(names))]
        r_hat, ess = map(np.concatenate, zip(*[diagnostics(draws[:, :, a : a + step]) for a in range(0, len(names), step)], strict=True))
        return pd.DataFrame({entity: names, "score_bayes": flat.mean(axis=0), "hdi_low": [a for a, _ in ends], "hdi_high": [b for _, b in ends], "r_hat": r_hat, "ess_bulk": ess})

    def listed(table):
        names, draws = draws_of(table)
        c, t, i = (k.ravel() for k in np.indices(draws.shape))
        return pd.DataFrame({"chain": c, "draw": t, entity: names[i], "value": draws.ravel()})

    blocks = spread_by(held.where("block >= 0"), "block")
    if draws_path:
        blocks.applyInPandas(listed, f"chain long, draw long, {entity} {kind}, value double").write.mode("overwrite").parquet(draws_path)
    return blocks.applyInPandas(summary, schema)


def regression_design(scores: DataFrame, cases: DataFrame, count_col: str, flags: list[str], group: str, age: str, key: str = "entity_id") -> DataFrame:
    """Scores with log count, 0/1 flags (only Y is 1), standardised age (gaps take the median) and a number for each group."""
    x = scores.join(cases, key)
    median = x.agg(F.median(F.col(age).cast("double")).alias("_median"), F.array_sort(F.collect_set(F.coalesce(group, F.lit("unknown")))).alias("_index"))
    x = x.crossJoin(F.broadcast(median)).withColumn("_age", F.coalesce(F.col(age).cast("double"), "_median")).withColumn("group", F.coalesce(group, F.lit("unknown")))
    stats = x.agg(F.avg("_age").alias("_m"), F.stddev_pop("_age").alias("_s"))
    x, index = x.crossJoin(F.broadcast(stats)), F.col("_index")
    return x.select(key, *[c for c in scores.columns if c != key], F.log(F.coalesce(F.col(count_col).cast("double"), F.lit(0.0)) + 1).alias("log_count"), *[F.coalesce((F.col(f) == "Y").cast("int"), F.lit(0)).alias(f) for f in flags], ((F.col("_age") - F.col("_m")) / (F.col("_s") + 1e-8)).alias("age_z"), "group", (F.array_position(index, F.col("group")) - 1).cast("int").alias("group_index"))


def _best_fit(sums: dict) -> tuple[np.ndarray, np.ndarray]:
    """Intercept with slopes, and group effects, of the least squares: the point from which _regression_draws counts squares."""
    share = sums["x"] / np.maximum(sums["n"], 1)[:, None]
    beta = np.linalg.pinv(sums["xx"] - sums["x"].T @ share, hermitian=True) @ (sums["xy"] - share.T @ sums["y"])
    return beta, (sums["y"] - sums["x"] @ beta) / np.maximum(sums["n"], 1)


def _regression_draws(sums: dict, best: tuple[np.ndarray, np.ndarray], left: dict, samples: int, tune: int, chains: int, seed: int) -> np.ndarray:
    """regression_draws from sums over the rows, so that memory goes with the groups.

    sums: by group n, x (with the intercept's 1) and y, of all rows xx and xy. left: of what `best` leaves of y, its
    square and its product with x, and by group its sum; without it, squares would lose digits where the fit is close.
    """
    groups, n, m = len(sums["n"]), sums["n"].sum(), len(sums["xy"])
    draws = []
    for chain in range(chains):
        rng = np.random.default_rng((seed, chain))
        beta, effect, s, noise = np.zeros(m), np.zeros(groups), 0.5, 1.0
        for t in range(tune + samples):
            precision = sums["xx"] / noise**2 + np.eye(m)
            root = np.linalg.cholesky(precision)
            mean = np.linalg.solve(precision, (sums["xy"] - sums["x"].T @ effect) / noise**2)
            beta = mean + np.linalg.solve(root.T, rng.normal(size=len(mean)))
            p = sums["n"] / noise**2 + 1 / s**2
            effect = (sums["y"] - sums["x"] @ beta) / noise**2 / p + rng.normal(size=groups) / np.sqrt(p)
            b, e = beta - best[0], effect - best[1]
            square = left["square"] - 2 * (b @ left["x"] + e @ left["group"]) + b @ sums["xx"] @ b + 2 * (sums["x"] @ b) @ e + sums["n"] @ e**2
            noise = _half_normal_slice(rng, noise, lambda v, q=square, n=n: -n * np.log(v) - q / (2 * v * v), 1.0)
            spread = (effect**2).sum()
            s = _half_normal_slice(rng, s, lambda v, q=spread: -groups * np.log(v) - q / (2 * v * v), 0.5)
            if t >= tune:
                draws.append(beta)
    return np.array(draws)


def regression_draws(x: np.ndarray, y: np.ndarray, group: np.ndarray, samples: int = 2000, tune: int = 1000, chains: int = 4, seed: int = 42) -> np.ndarray:
    """Draws (chain * sample, intercept and slopes) of y on x with a normal intercept for each group.

    Intercept and slopes ~ N(0, 1), group effects ~ N(0, s), s ~ half-normal(0.5), noise ~ half-normal(1).
    """
    x1 = np.column_stack([np.ones(len(y)), x])
    groups = int(group.max()) + 1 if len(group) else 0

    def by_group(v):
        return np.bincount(group, v, minlength=groups)

    sums = {"n": by_group(np.ones(len(y))), "x": np.column_stack([by_group(c) for c in x1.T]), "y": by_group(y), "xx": x1.T @ x1, "xy": x1.T @ y}
    best = _best_fit(sums)
    rest = y - x1 @ best[0] - best[1][group]
    return _regression_draws(sums, best, {"square": rest @ rest, "x": x1.T @ rest, "group": by_group(rest)}, samples, tune, chains, seed)


def fit_regression(x: np.ndarray, y: np.ndarray, group: np.ndarray, names: list[str], samples: int = 2000, tune: int = 1000, chains: int = 4, seed: int = 42, prob: float = 0.89) -> list[dict]:
    """Mean and narrowest interval of the intercept and each coefficient, from arrays."""
    draws = regression_draws(x, y, group, samples, tune, chains, seed)
    ends = [hdi(draws[:, k], prob) for k in range(draws.shape[1])]
    return [{"term": t, "mean": float(draws[:, k].mean()), "hdi_low": ends[k][0], "hdi_high": ends[k][1]} for k, t in enumerate(["intercept", *names])]


def regression(design: DataFrame, score: str, terms: list[str], group: str = "group_index", prob: float = 0.89, draws_path: str | None = None, samples: int = 2000, tune: int = 1000, chains: int = 4, seed: int = 42) -> DataFrame:
    """(term, mean, sd, hdi_low, hdi_high, r_hat, ess_bulk) of the intercept and each term, from regression_design's rows without a score left out.

    Null terms count as 0. Tasks sum up the rows; the driver holds a row a group. draws_path: where all draws are written as Parquet.
    """
    spark, names = design.sparkSession, ["intercept", *terms]
    x = ["_x0", *[f"_x{k + 1}" for k in range(len(terms))]]
    rows = design.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("_y"), F.col(group).alias("_g"), F.lit(1.0).alias("_x0"), *[F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias(c) for c, t in zip(x[1:], terms, strict=True)])
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    # a row a group
    found = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(F.col("_y") * F.col(c)).alias(f"y{i}") for i, c in enumerate(x)], *[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"p{i}_{j}") for i, j in pairs]).orderBy("_g").toPandas()
    schema = "term string, mean double, sd double, hdi_low double, hdi_high double, r_hat double, ess_bulk double"
    if not len(found):
        return spark.createDataFrame([], schema)
    _few_enough(int(found["n"].sum()), MOST_ENTITIES)
    at = found["_g"].to_numpy(int)

    def by_group(table, columns):
        out = np.zeros((at.max() + 1, len(columns)))
        out[at] = table[columns].to_numpy(float)
        return out

    xx = np.empty((len(x), len(x)))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = found[f"p{i}_{j}"].sum()
    sums = {"n": by_group(found, ["n"])[:, 0], "x": by_group(found, [f"s{i}" for i in range(len(x))]), "y": by_group(found, ["y"])[:, 0], "xx": xx, "xy": found[[f"y{i}" for i in range(len(x))]].to_numpy(float).sum(axis=0)}
    best = _best_fit(sums)
    effects = spark.createDataFrame(list(zip(at.tolist(), best[1][at].tolist(), strict=True)), "_g long, _e double")
    rest = rows.join(effects, "_g").withColumn("_r", F.col("_y") - F.col("_e") - sum((F.col(c) * F.lit(float(v)) for c, v in zip(x, best[0], strict=True)), F.lit(0.0)))
    after = rest.groupBy("_g").agg(F.sum("_r").alias("r"), F.sum(F.col("_r") * F.col("_r")).alias("q"), *[F.sum(F.col("_r") * F.col(c)).alias(f"r{i}") for i, c in enumerate(x)]).orderBy("_g").toPandas()
    left = {"square": after["q"].sum(), "x": after[[f"r{i}" for i in range(len(x))]].to_numpy(float).sum(axis=0), "group": by_group(after, ["r"])[:, 0]}
    draws = _regression_draws(sums, best, left, samples, tune, chains, seed)
    if draws_path:
        _draw_rows(spark, draws, chains, names, "string", "term").write.mode("overwrite").parquet(draws_path)
    r_hat, ess = diagnostics(draws.reshape(chains, samples, -1))
    return spark.createDataFrame([(t, float(draws[:, k].mean()), float(draws[:, k].std(ddof=1)), *hdi(draws[:, k], prob), float(r_hat[k]), float(ess[k])) for k, t in enumerate(names)], schema)
