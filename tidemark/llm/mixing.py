"""Mixing documents to target weights by soft domain membership. DataFrame and SQL functions only.

A classifier of a labelled table, log odds of words calibrated by a softmax regression, gives every
document a posterior over the domains.
Non-negative rates, one a document, are then fitted by projected gradient so that the expected
tokens of each domain, sum(rate * tokens * posterior), meet the targets in least squares of the
relative misses. A gradient needs one sum a domain, so each step is one aggregate over the table
of posteriors and the driver holds a few numbers for each step; the rates themselves are a fold
of those steps, and are written to the cluster's checkpoint folder every few steps.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, checkpointed, join_spread, outer_id, whole_row

SYMBOLS = "%*#$&!|=<>{}[]\\^~@_"


def words(documents: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys and one row for each word: words with symbols, and words in capitals, are one feature each."""
    flat = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "\n\r\t", "   "), " ")
    rows = documents.select(*keys, F.explode(flat).alias("w")).where("w <> ''")
    symbol = F.col("w") != F.translate("w", SYMBOLS, "")
    capital = (F.length("w") > 1) & (F.col("w") == F.upper("w")) & (F.col("w") != F.lower("w"))
    return rows.select(*keys, F.when(symbol, "%%").when(capital, "AA").otherwise(F.lower("w")).alias("w"))


def _words_of(documents: DataFrame, labelled: DataFrame, domains: list[str], fit_rows: int, least: float, strength: float, id_col: str, text_col: str, domain_col: str):
    """What is learnt from about 2 * fit_rows labelled documents a domain, drawn by a hash of the id.

    Returns the words that tell domains apart with their log odds, the other half of the sample, and
    the documents of each domain. A word is kept where the likelihood ratio of its share in a domain
    against its share in all is that of `strength` standard errors and it makes at least `least` of the domain's words: at most
    1/least words a domain, which bounds what is broadcast.
    """
    rows = labelled.select(F.col(id_col).alias("key"), F.col(domain_col).alias("domain")).where(F.col("domain").isin(domains) & F.col("key").isNotNull())
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    share = F.create_map(*[x for d in domains for x in (F.lit(d), F.lit(min(1.0, 2 * fit_rows / max(1, sizes.get(d, 0)))))])
    drawn = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) / float(1 << 30) < share[F.col("domain")]
    sample = rows.where(drawn).limit(8 * fit_rows * len(domains))
    texts = documents.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(sample), "key")
    texts = checkpointed(texts.withColumn("half", F.pmod(F.xxhash64("key", F.lit(6)), F.lit(2))))
    n = range(len(domains))
    counts = checkpointed(words(texts.where("half = 0"), "text", ["domain"]).groupBy("w").agg(*[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)]))
    totals = counts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in n]).first()
    every, all_ = sum((F.col(f"n{k}") for k in n), F.lit(0)), sum(totals)
    scores, tells = [], F.lit(False)
    for k in n:
        own, rest = F.col(f"n{k}"), every - F.col(f"n{k}")
        odds = F.log((own + 0.5) / (totals[k] + 1.0)) - F.log((rest + 0.5) / (all_ - totals[k] + 1.0))
        part = totals[k] / max(1, all_)
        surprise = 2 * (own * F.log((own + 1e-9) / (every * part + 1e-9)) + rest * F.log((rest + 1e-9) / (every * (1 - part) + 1e-9)))
        firm = (surprise >= strength**2) & (F.greatest(own / float(max(1, totals[k])), rest / float(max(1, all_ - totals[k]))) >= least)
        scores.append(F.when(firm, odds).otherwise(0.0).alias(f"s{k}"))
        tells = tells | firm
    return counts.where(tells).select("w", *scores), texts.where("half = 1"), sizes


def _signals(documents: DataFrame, table: DataFrame, keys: list[str], n: range) -> DataFrame:
    """(keys, tokens, f0, ...): words of each text, and its domains' log odds, signed and dampened."""
    # a leading word that is always there keeps documents without words
    held = documents.select(*keys, F.concat(F.lit("%% "), F.coalesce("text", F.lit(""))).alias("text"))
    joined = words(held, "text", keys).join(F.broadcast(table), "w", "left")
    seen = joined.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("tokens"), *[F.coalesce(F.sum(f"s{k}"), F.lit(0.0)).alias(f"t{k}") for k in n])
    return seen.select(*keys, "tokens", *[F.asinh(F.col(f"t{k}")).alias(f"f{k}") for k in n])


def _softmax_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, ridge: float = 1.0, steps: int = 400) -> np.ndarray:
    """Weights (classes, features) of a softmax regression, by gradient steps with momentum."""
    w = np.zeros((classes, x.shape[1]))
    held, speed, pace = w.copy(), 4 / max(1e-9, (weight[:, None] * x * x).sum() + ridge), 1.0
    truth = np.eye(classes)[y]
    for _ in range(steps):
        z = x @ held.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = held - speed * ((weight[:, None] * (p - truth)).T @ x + ridge * held)
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        held, w, pace = new + (pace - 1) / next_pace * (new - w), new, next_pace
    return w


def posteriors(documents: DataFrame, labelled: DataFrame, domains: list[str], fit_rows: int = 1500, least: float = 5e-5, strength: float = 4.0, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """(row, id, tokens, p0, p1, ...): a row for every document, with its posterior over the domains.

    The log odds of a document's words are calibrated on the half of the sample that they were not
    learnt from. Without labelled rows every posterior is even. Tokens are words between white space.
    """
    n = range(len(domains))
    table, other, sizes = _words_of(documents, labelled, domains, fit_rows, least, strength, id_col, text_col, domain_col)
    sample = _signals(other.select("key", "domain", "text"), table, ["key", "domain"], n).select("domain", *[f"f{k}" for k in n]).collect()  # bounded by fit_rows
    weights = np.zeros((len(domains), len(domains) + 1))
    if sample:
        y = np.array([domains.index(r["domain"]) for r in sample])
        x = np.array([[1.0, *(r[f"f{k}"] for k in n)] for r in sample])
        drawn = np.bincount(y, minlength=len(domains))
        weights = _softmax_fit(x, y, np.array([sizes[domains[k]] / drawn[k] for k in y]) * len(y) / sum(sizes.values()), len(domains))
    # each document is a row of its own, even one that is repeated
    x = documents.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _signals(x, table, ["row", "id"], n)
    score = [sum((F.lit(float(weights[k, j + 1])) * F.col(f"f{j}") for j in n), F.lit(float(weights[k, 0]))) for k in n]
    scored = found.select("row", "id", "tokens", *[c.alias(f"l{k}") for k, c in enumerate(score)])
    top = F.greatest(*[F.col(f"l{k}") for k in n]) if len(domains) > 1 else F.col("l0")
    risen = scored.select("row", "id", "tokens", *[F.exp(F.col(f"l{k}") - top).alias(f"e{k}") for k in n])
    total = sum((F.col(f"e{k}") for k in n), F.lit(0.0))
    return risen.select("row", "id", "tokens", *[(F.col(f"e{k}") / total).alias(f"p{k}") for k in n])


def log_loss(documents: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", **fit) -> tuple[float, float]:
    """(mean log loss of the posteriors on one labelled document in five, which nothing is learnt from; that of the priors)."""
    rows = labelled.select(F.col(id_col).alias("key"), F.col(domain_col).alias("domain")).where(F.col("domain").isin(domains) & F.col("key").isNotNull())
    held = F.pmod(F.xxhash64("key", F.lit(17)), F.lit(5)) == 0
    found = posteriors(documents, rows.where(~held).select(F.col("key").alias(id_col), F.col("domain").alias(domain_col)), domains, id_col=id_col, text_col=text_col, domain_col=domain_col, **fit)
    own = F.lit(0.0)
    for k, d in enumerate(domains):
        own = F.when(F.col("domain") == d, F.col(f"p{k}")).otherwise(own)
    joined = found.join(rows.where(held), F.col("id") == F.col("key")).select("domain", (-F.log(F.greatest(own, F.lit(1e-12)))).alias("loss"))
    sums = {r["domain"]: (r["n"], r["s"]) for r in joined.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("s")).collect()}
    n = sum(k for k, _ in sums.values())
    return (sum(s for _, s in sums.values()) / n, -sum(k / n * np.log(k / n) for k, _ in sums.values())) if n else (float("nan"), float("nan"))


def _descend(rate: Column, before: Column, steps: list[tuple[list[float], float]], least: float, n: range) -> Column:
    """struct(rate, before) after some gradient steps with momentum: x' = max(least, y - p.g), y = x + m (x - x_before)."""
    start = F.struct(rate.alias("rate"), before.alias("before"))
    if not steps:
        return start
    array = F.array(*[F.struct(*[F.lit(float(g)).alias(f"g{k}") for k, g in enumerate(gs)], F.lit(float(m)).alias("m")) for gs, m in steps])

    def one(state, step):
        y = state["rate"] + step["m"] * (state["rate"] - state["before"])
        down = sum((F.col(f"p{k}") * step[f"g{k}"] for k in n), F.lit(0.0))
        return F.struct(F.greatest(F.lit(float(least)), y - down).alias("rate"), state["rate"].alias("before"))

    return F.aggregate(array, start, one)


def fit_rates(state: DataFrame, targets: list[float], least: float = 0.0, tolerance: float = 1e-3, keep_every: int = 8, patience: int = 25) -> DataFrame:
    """state (row, id, tokens, p0, ...) with column rate >= least, from 1 downhill until every domain's total is within `tolerance` of its target or no step helps.

    Projected gradient steps, an aggregate each. The gradient is a vector of the domains' misses. As long as
    that lessens the misses it is scaled by the curvature of the documents whose rates are free to move, which makes
    most fits a matter of a few steps; then steps are plain ones with momentum. Where `patience` of them gain
    less than a tenth of what is missing, the targets can't be met by rates of at least `least`: the rates are near those of
    least squares, and a warning says by how much they miss. A step is measured in tokens, so two documents with one
    posterior get one rate however long they are.
    """
    n, d = range(len(targets)), len(targets)
    goal = np.array([max(float(t), 1e-9) for t in targets])
    out = state.withColumn("rate", F.lit(1.0)).withColumn("before", F.lit(1.0))
    taken: list[tuple[list[float], float]] = []  # steps since rates were last written

    def look(step=None):
        """Totals over targets now and a step before, curvature of the free documents, and of all, after one more step."""
        at = out.select("tokens", *[f"p{i}" for i in n], _descend(F.col("rate"), F.col("before"), taken + ([step] if step else []), least, n).alias("s"))
        weigh = [F.col("tokens") * F.col(f"p{i}") for i in n]
        pairs = [weigh[i] * F.col(f"p{j}") for i in n for j in n]
        wanted = [w * F.col("s.rate") for w in weigh] + [w * F.col("s.before") for w in weigh] + [F.when(F.col("s.rate") > least, p) for p in pairs] + pairs
        found = np.array(at.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"x{k}") for k, x in enumerate(wanted)]).first(), float)
        scale = np.outer(goal, goal)
        return found[:d] / goal, found[d : 2 * d] / goal, *(found[2 * d + k * d * d :][: d * d].reshape(d, d) / scale for k in (0, 1))

    x, before, free, every = look()
    miss, steep = float(((x - 1) ** 2).sum()), float(np.linalg.eigvalsh(every).max())
    scaled, pace, plain, then = True, 1.0, 0, np.inf
    while steep > 0 and np.abs(x - 1).max() > tolerance:
        if scaled:
            step = (np.linalg.lstsq(free, x - 1, rcond=1e-9)[0] / goal).tolist(), 0.0
        else:
            plain += 1
            if plain % patience == 0:
                if miss > 0.9 * then:
                    break
                then = miss
            next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            momentum, pace = (pace - 1) / next_pace, next_pace
            step = ((x + momentum * (x - before) - 1) / goal / steep).tolist(), momentum
        new, new_before, new_free, _ = look(step)
        new_miss = float(((new - 1) ** 2).sum())
        if scaled and new_miss > 0.9 * miss:
            scaled = False
            continue
        pace = 1.0 if new_miss > miss else pace  # momentum overshot: start it anew
        taken.append(step)
        x, before, free, miss = new, new_before, new_free, new_miss
        if len(taken) == keep_every:
            out, taken = _written(out, taken, least, n), []
    if np.abs(x - 1).max() > tolerance:
        warnings.warn(f"targets missed: domains hold {np.round(x, 4).tolist()} of their targets", stacklevel=2)
    return (_written(out, taken, least, n) if taken else out).drop("before")


def _written(out: DataFrame, steps: list[tuple[list[float], float]], least: float, n: range) -> DataFrame:
    s = out.withColumn("s", _descend(F.col("rate"), F.col("before"), steps, least, n))
    return checkpointed(s.select("row", "id", "tokens", *[f"p{i}" for i in n], "s.rate", "s.before"))


def mixture_rates(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], total_tokens: float | None = None, keep_all: bool = False, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", **fit) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_<domain> for each domain of targets, rate.

    labelled: (doc_id, domain) of some documents; other domains, and null ids and domains, are left out.
    targets: weight of each domain. total_tokens: what the mixture is to hold, by default what the
    documents hold. keep_all: no rate falls below 1, and the default total is the least for which
    no domain has to shrink. Null and empty texts have no tokens and the posterior of the priors.
    Rows that repeat are documents of their own; other columns are not read.
    """
    domains = sorted(targets)
    if not domains or any(w < 0 for w in targets.values()) or sum(targets.values()) <= 0:
        raise ValueError("targets are non-negative weights, some above zero")
    n = range(len(domains))
    state = checkpointed(posteriors(documents, labelled, domains, id_col=id_col, text_col=text_col, domain_col=domain_col, **fit))
    have = np.array(state.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col(f"p{k}")), F.lit(0.0)).alias(f"x{k}") for k in n]).first(), float)
    share = np.array([targets[d] for d in domains], float) / sum(targets.values())
    if total_tokens is None:
        total_tokens = float(max(h / s for h, s in zip(have, share, strict=True) if s > 0)) if keep_all else float(have.sum())
    rated = fit_rates(state, (share * total_tokens).tolist(), least=1.0 if keep_all else 0.0)
    return rated.select(outer_id().alias(id_col), F.col("tokens").alias("n_tokens"), *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)], "rate")


def copies(rate: Column, key: Column) -> Column:
    """Whole copies for a rate: its whole part, and one more with the probability of the rest, by a hash of key."""
    drawn = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + drawn).cast("int")


def mix(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, each repeated as its rate asks, with their columns. Rows that share an id share the mean of their rates."""
    rates = mixture_rates(documents, labelled, targets, id_col=id_col, text_col=text_col, **options)
    wanted = rates.groupBy(F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("_mix_id")).agg(F.avg("rate").alias("_mix_rate"))
    keyed = documents.select(whole_row(documents), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_mix_id"))
    times = join_spread(keyed, wanted, "_mix_id").withColumn("_mix_n", copies(F.col("_mix_rate"), F.col("_mix_id"))).where("_mix_n > 0")
    return times.select("_row", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select("_row.*")
