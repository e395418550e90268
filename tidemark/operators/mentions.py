"""Which posts mention which entity: aliases, lexical passes, retrieval, adjudication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..functions.scalars import first_filled, sigmoid, unit
from .relational import broadcast_if_few, first_by_precedence, modular_sample, sample_rows, thread_neighbours, top_per_key

PRECEDENCE = ["exact_substring", "adversarial_norm", "phonetic_skeleton", "fuzzy", "semantic"]
OBLIQUE = ("semantic", "phonetic_skeleton")
_SKIP = ("", "null", "none", "n/a")


def aliases(cases: DataFrame, entity: str = "entity_id", names: tuple[str, ...] = ("name",), alias_lists: tuple[str, ...] = ("aliases", "handles")) -> DataFrame:
    """(entity, alias, source): full name, last word of a name of two words or more, and listed aliases. Columns that are missing are passed over."""
    have = [c for c in names if c in cases.columns]
    name = F.trim(first_filled(*[F.col(c) for c in have])) if have else F.lit(None).cast("string")
    words = F.split(name, r"\s+")
    parts = [cases.select(entity, name.alias("alias"), F.lit("name").alias("source")), cases.select(entity, F.when(F.size(words) >= 2, F.element_at(words, -1)).alias("alias"), F.lit("last_name").alias("source"))]
    parts += [cases.select(entity, F.explode(T.split_list(F.col(c))).alias("alias"), F.lit(c).alias("source")) for c in alias_lists if c in cases.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sound = out.where(F.col("alias").isNotNull() & ~F.lower("alias").isin(*_SKIP))
    return first_by_precedence(sound, [entity, "alias"], "source", ["name", "last_name", *alias_lists], ["source"])


def _pattern_blocks(patterns: DataFrame, most: int) -> list[list[str]]:
    """The distinct patterns in blocks of about `most`, by a hash: what one worker's automaton holds."""
    distinct = patterns.select("pattern").where("pattern <> ''").distinct()
    n = distinct.count()
    blocks = -(-n // max(1, most))
    part = F.pmod(F.xxhash64("pattern"), F.lit(max(1, blocks)))
    return [[r[0] for r in distinct.where(part == k).orderBy("pattern").collect()] for k in range(blocks)]


def _contained(posts: DataFrame, patterns: DataFrame, text: str, post: str, most: int) -> DataFrame:
    """(post, pattern) for each pattern that a text contains: an automaton over about `most` patterns a worker, a pass over the posts for each such block."""
    udfs.short_batches(posts.sparkSession)
    out = posts.where("false").select(post, F.lit("").alias("pattern"))
    for k, names in enumerate(_pattern_blocks(patterns, most)):
        found = posts.select(post, F.explode(udfs.contained(names)(F.col(text))).alias("pattern"))
        out = found if k == 0 else out.unionByName(found)
    return out


def _escaped(c: Column) -> Column:
    """A text as a regular expression that matches it literally."""
    return F.regexp_replace(c, r"([\\\[\](){}.*+?^$|])", r"\\$1")


def exact_mentions(posts: DataFrame, alias_table: DataFrame, entity: str = "entity_id", post: str = "post_id", text: str = "body_clean", least: int = 4, most_aliases: int = 50_000, word_boundary: bool = False) -> DataFrame:
    """Posts whose text contains an alias of `least` characters or more, score 1. An alias may belong to several entities."""
    low = alias_table.select(entity, F.lower("alias").alias("pattern")).where(F.length("pattern") >= least).distinct()
    hits = _contained(posts, low.select("pattern"), text, post, most_aliases).join(low, "pattern")
    if word_boundary:
        hits = hits.join(posts.select(post, text), post).where(F.rlike(F.col(text), F.concat(F.lit(r"(?U)\b"), _escaped(F.col("pattern")), F.lit(r"\b")))).drop(text)
    return hits.select(post, entity, F.col("pattern").alias("alias_matched"), F.lit("exact_substring").alias("match_type"), F.lit(1.0).alias("score"))


def _forms(alias_table: DataFrame, entity: str, least: int) -> DataFrame:
    """(entity, pattern): aliases and their variants."""
    low = alias_table.select(entity, F.lower("alias").alias("low")).where(F.length("low") >= least)
    return low.select(entity, F.explode(F.array_distinct(F.concat(F.array("low"), T.variants(F.col("low"))))).alias("pattern")).where(F.length("pattern") >= least).distinct()


def _skeletons(alias_table: DataFrame, entity: str, least: int) -> DataFrame:
    """(entity, low, skel) of the aliases whose skeleton has three letters or more."""
    low = alias_table.select(entity, F.lower("alias").alias("low")).where(F.length("low") >= least)
    return low.select(entity, "low", T.skeleton(F.col("low")).alias("skel")).where(F.length("skel") >= 3).distinct()


def _long_words(norm: Column, least: int) -> Column:
    return F.filter(F.array_distinct(F.split(norm, " ")), lambda w: F.length(w) >= least)


def adversarial_mentions(posts: DataFrame, alias_table: DataFrame, entity: str = "entity_id", post: str = "post_id", text: str = "body_clean", least: int = 4, most_aliases: int = 50_000) -> DataFrame:
    """Posts whose normalised text contains an alias or one of its variants, score 0.9."""
    forms = _forms(alias_table, entity, least)
    normal = posts.select(post, T.adversarial(F.col(text)).alias("_norm"))
    hits = _contained(normal, forms.select("pattern"), "_norm", post, most_aliases).join(forms, "pattern")
    return hits.select(post, entity, F.col("pattern").alias("alias_matched"), F.lit("adversarial_norm").alias("match_type"), F.lit(0.9).alias("score"))


def skeleton_mentions(posts: DataFrame, alias_table: DataFrame, entity: str = "entity_id", post: str = "post_id", text: str = "body_clean", least: int = 4) -> DataFrame:
    """Posts with a word whose consonant skeleton is an alias's, and which is not the alias, score 0.8."""
    words = posts.select(post, F.explode(_long_words(T.adversarial(F.col(text)), least)).alias("token"))
    keyed = words.withColumn("skel", T.skeleton(F.col("token")))
    return keyed.join(_skeletons(alias_table, entity, least), "skel").where("token <> low").select(post, entity, F.col("token").alias("alias_matched"), F.lit("phonetic_skeleton").alias("match_type"), F.lit(0.8).alias("score"))


def _three_passes(posts: DataFrame, alias_table: DataFrame, entity: str, post: str, text: str, least: int, most: int) -> DataFrame:
    """The exact, normalised and skeleton passes in one over the posts, which are normalised once; patterns are up to `most`."""
    udfs.short_batches(posts.sparkSession)
    exact = alias_table.select(entity, F.lower("alias").alias("pattern")).where(F.length("pattern") >= least).distinct()
    forms, skeletons = _forms(alias_table, entity, least), _skeletons(alias_table, entity, least)
    kinds = {"exact_substring": 1.0, "adversarial_norm": 0.9, "phonetic_skeleton": 0.8}
    first, second, third = (F.lit(k) for k in kinds)
    found = {k: _pattern_blocks(x.select("pattern"), most) for k, x in (("e", exact), ("f", forms))}
    if max(map(len, found.values())) > 1:
        names = {"entity": entity, "post": post, "text": text, "least": least}
        parts = exact_mentions(posts, alias_table, **names), adversarial_mentions(posts, alias_table, **names), skeleton_mentions(posts, alias_table, **names)
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def hits(blocks: list[list[str]], c: str, kind: Column) -> Column:
        return F.transform(udfs.contained(blocks[0] if blocks else [])(F.col(c)), lambda p: F.struct(kind.alias("match_type"), p.alias("token")))

    normal = posts.select(post, text, T.adversarial(F.col(text)).alias("_norm"))
    words = F.transform(F.coalesce(_long_words(F.col("_norm"), least), F.array().cast("array<string>")), lambda w: F.struct(third.alias("match_type"), w.alias("token")))
    each = normal.select(post, F.explode(F.concat(hits(found["e"], text, first), hits(found["f"], "_norm", second), words)).alias("h")).select(post, "h.match_type", "h.token")
    each = each.withColumn("key", F.when(F.col("match_type") == third, T.skeleton(F.col("token"))).otherwise(F.col("token")))
    keys = exact.select(entity, first.alias("match_type"), F.col("pattern").alias("key"), F.lit(None).cast("string").alias("low"))
    keys = keys.unionByName(forms.select(entity, second.alias("match_type"), F.col("pattern").alias("key"), F.lit(None).cast("string").alias("low")))
    keys = keys.unionByName(skeletons.select(entity, third.alias("match_type"), F.col("skel").alias("key"), "low"))
    joined = each.join(broadcast_if_few(keys, keys, most), ["match_type", "key"]).where("low is null or token <> low")
    score = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("match_type")]
    return joined.select(post, entity, F.col("token").alias("alias_matched"), "match_type", score.alias("score"))


def _letters(token: Column) -> Column:
    """The letters of a word as bits, by their codes modulo 64."""
    bits = F.transform(F.split(token, ""), lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(x), F.lit(64))))
    return F.coalesce(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)), F.lit(0).cast("long"))


def fuzzy_mentions(posts: DataFrame, alias_table: DataFrame, entity: str = "entity_id", post: str = "post_id", text: str = "body_clean", threshold: float = 85.0, least: int = 4, most_words: int = 3, most_names: int = 50_000) -> DataFrame:
    """For each post and alias of up to most_words words, the first word that is like one of its words: insert-delete ratio >= threshold.

    Words that pass share a length band. The sets of their letters, of which an insertion or deletion changes one at
    most, and Levenshtein distance, never above the insert-delete distance, rule out the rest before the ratio is computed. Distinct words are compared once. Up to
    most_names words of aliases are broadcast; more are joined on the length by a shuffle.
    """
    low = alias_table.select(entity, F.lower("alias").alias("low")).where(F.length("low") >= least).distinct()
    parts = low.select(entity, "low", F.posexplode(T.tokens(F.col("low"))).alias("alias_pos", "alias_token")).where(F.size(T.tokens(F.col("low"))) <= most_words).where(F.length("alias_token") >= least)
    words = posts.select(post, F.posexplode(T.tokens(F.col(text))).alias("token_pos", "token")).where(F.length("token") >= least)
    share = 2 * threshold / (200 - threshold)  # the longer word's part that the shorter must have: min/max >= t / (200 - t)
    vocabulary, names = words.select("token").distinct(), parts.select("alias_token").distinct()
    lengths = F.explode(F.sequence(F.ceil(F.length("alias_token") * share / 2).cast("int"), F.floor(F.length("alias_token") * 2 / share).cast("int")))
    keyed = names.withColumns({"n": lengths, "_alias_letters": _letters(F.col("alias_token"))})
    # few bytes, much work: adaptive execution would make one task of the distinct words
    tasks = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    close = vocabulary.repartition(tasks).withColumns({"n": F.length("token"), "_letters": _letters(F.col("token"))}).join(broadcast_if_few(keyed, names, most_names), "n")
    most = ((1 - threshold / 100) * (F.length("token") + F.length("alias_token"))).cast("int")
    differ = F.bit_count(F.col("_letters").bitwiseXOR(F.col("_alias_letters")))
    close = close.where(F.when(differ <= most, F.levenshtein("token", "alias_token")) <= most)
    close = close.withColumn("ratio", udfs.indel_ratio(F.col("token"), F.col("alias_token"))).where(F.col("ratio") >= threshold).select("token", "alias_token", "ratio")
    hits = words.join(close, "token").join(parts, "alias_token")
    first = top_per_key(hits, [post, entity, "low"], [F.col("token_pos"), F.col("alias_pos")], 1)
    return first.select(post, entity, F.col("token").alias("alias_matched"), F.lit("fuzzy").alias("match_type"), (F.col("ratio") / 100).alias("score"))


def lexical_candidates(posts: DataFrame, alias_table: DataFrame, entity: str = "entity_id", post: str = "post_id", text: str = "body_clean", sample_target: int | None = 500_000, offset: int = 0, threshold: float = 85.0, least: int = 4) -> DataFrame:
    """All passes, one row a post and entity by precedence; the costly ones on a modular sample of the posts, or on all if sample_target is None."""
    names = {"entity": entity, "post": post, "text": text, "least": least}
    if sample_target is None:
        some, out = posts, _three_passes(posts, alias_table, most=50_000, **names)
    else:
        some = modular_sample(posts, post, sample_target, offset)
        out = exact_mentions(posts, alias_table, **names).unionByName(adversarial_mentions(some, alias_table, **names)).unionByName(skeleton_mentions(some, alias_table, **names))
    out = out.unionByName(fuzzy_mentions(some, alias_table, threshold=threshold, **names))
    return first_by_precedence(out, [post, entity], "match_type", PRECEDENCE, ["alias_matched"])


def probe_texts(cases: DataFrame, entity: str, name: str, place: str, year: str, venue: str | None = None) -> DataFrame:
    """Sentences that a post about the case might hold, for its centroid."""
    lines = [F.format_string("%s carried out an event in %s", name, place), F.format_string("the %s event of %s", place, F.col(year).cast("string")), F.format_string("posts about %s", name)]
    if venue:
        lines.append(F.when(F.col(venue).isNotNull(), F.format_string("the event at %s", venue)))
    return cases.select(entity, F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("text"))


def vector_mean(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, centroid, n): one average a component, summed in each task before the shuffle."""
    means = [F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(dim)]
    return vectors.groupBy(key).agg(*means, F.count(F.lit(1)).alias("n")).select(key, F.array(*[f"m{i}" for i in range(dim)]).alias("centroid"), "n")


def _nearest(centres: np.ndarray, post: str, vector: str, n: int):
    """The n posts of each task that are closest to each centre: (place of the centre, post, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_score, best_post = np.full((len(centres), 0), -np.inf), np.zeros((len(centres), 0), np.int64)
        kept: list[pa.Array] = []  # ids of posts that are in best_post, by their place
        count = 0
        for batch in batches:
            held = batch.filter(batch.column(vector).is_valid())
            if not held.num_rows:
                continue
            column = held.column(vector)
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(held.num_rows, -1)
            kept.append(held.column(post))
            score = np.concatenate([best_score, centres @ x.T], axis=1)
            place = np.concatenate([best_post, np.broadcast_to(np.arange(count, count + held.num_rows), (len(centres), held.num_rows))], axis=1)
            count += held.num_rows
            ids_now = pa.concat_arrays(kept)
            key = pc.rank(ids_now, "ascending").to_numpy()  # ties go to the smaller id
            order = np.lexsort((key[place], -score), axis=1)[:, :n]
            best_score, best_post = np.take_along_axis(score, order, 1), np.take_along_axis(place, order, 1)
            used, back = np.unique(best_post, return_inverse=True)
            kept, count, best_post = [ids_now.take(pa.array(used))], len(used), back.reshape(best_post.shape)
        if kept:
            rows, columns = best_post.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(rows), columns)), kept[0].take(pa.array(best_post.ravel())), pa.array(best_score.ravel())], names=["centre", post, "score"])

    return run


def centroid_candidates(posts: DataFrame, probes: DataFrame, dim: int, entity: str = "entity_id", post: str = "post_id", vector: str = "embedding", n: int = 500, most_centres: int = 10_000) -> DataFrame:
    """The n posts closest to each entity's mean probe vector by dot product; ties by id. Posts without a vector are left out.

    The centroids are a query set, a row an entity. Up to most_centres of them are a matrix that every task
    multiplies its posts' vectors with, keeping its n best of each; more take a pass over the posts for each such block.
    """
    spark = posts.sparkSession
    centres = vector_mean(probes, entity, vector, dim).select(entity, unit(F.col("centroid")).alias("centroid"))
    total = probes.select(entity).distinct().count()
    blocks = max(1, -(-total // max(1, most_centres)))
    kind = posts.schema[post].dataType.simpleString()
    out = None
    for k in range(blocks):
        part = [r for r in centres.where(F.pmod(F.xxhash64(entity), F.lit(blocks)) == k).orderBy(entity).collect()]
        names = spark.createDataFrame([(i, r[entity]) for i, r in enumerate(part)], f"centre long, {entity} {probes.schema[entity].dataType.simpleString()}")
        if not part:
            continue
        near = posts.select(post, vector).mapInArrow(_nearest(np.array([r["centroid"] for r in part], np.float64), post, vector, n), f"centre long, {post} {kind}, score double")
        best = top_per_key(near, "centre", [F.col("score").desc(), F.col(post)], n).join(F.broadcast(names), "centre")
        found = best.select(post, entity, F.lit("").alias("alias_matched"), F.lit("semantic").alias("match_type"), "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else posts.select(post).where("false").crossJoin(probes.select(entity).limit(0)).select(post, entity, F.lit("").alias("alias_matched"), F.lit("semantic").alias("match_type"), F.lit(0.0).alias("score"))


def thread_candidates(posts: DataFrame, hits: DataFrame, probes: DataFrame, dim: int, thread: str = "thread_id", entity: str = "entity_id", post: str = "post_id", vector: str = "embedding", n: int = 50, most_posts: int | None = 2_000_000, seed: int = 42) -> DataFrame:
    """Retrieval among the posts of threads that hold a lexical hit: up to most_posts of them, drawn by a seeded hash (all if None), the n closest to each entity's centroid."""
    scope = thread_neighbours(posts, hits, post, thread)
    if most_posts is not None:
        scope = sample_rows(scope, post, most_posts, seed)
    return centroid_candidates(scope, probes, dim, entity, post, vector, n)


def all_candidates(lexical: DataFrame, semantic: DataFrame, entity: str = "entity_id", post: str = "post_id") -> DataFrame:
    """Lexical and retrieved candidates, one row a post and entity by precedence."""
    return first_by_precedence(lexical.unionByName(semantic), [post, entity], "match_type", PRECEDENCE, ["alias_matched"])


def adjudicate(candidates: DataFrame, posts: DataFrame, names: DataFrame, logit: Callable[[Column, Column], Column], model: str, entity: str = "entity_id", post: str = "post_id", text: str = "body_clean", name: str = "name", threshold: float = 0.5, limit: int = 512, cache: DataFrame | None = None, need_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(mentions, new cache rows). Exact matches are accepted; the others are scored by logit(question, text).

    A score in the cache (post, entity, model_name, confidence) is taken before the text is looked at;
    a candidate without text is refused with confidence 0, or scored like the others if not need_text. One of no
    match_type is scored, but whether it is oblique is unknown. The cache's new rows are those scored here that have one.
    """
    exact = F.col("match_type").eqNullSafe("exact_substring")
    shape = [post, entity, "is_reference", "confidence", "inferred_alias", "is_oblique", "source_stage", "alias_matched"]
    sure = candidates.where(exact).select(post, entity, F.lit(True).alias("is_reference"), F.lit(1.0).alias("confidence"), F.lit("").alias("inferred_alias"), F.lit(False).alias("is_oblique"), F.col("match_type").alias("source_stage"), "alias_matched")
    rest = candidates.where(~exact).dropDuplicates([post, entity, "match_type"])
    known = cache.where(F.col("model_name") == model).groupBy(post, entity).agg(F.max("confidence").alias("_known")) if cache is not None else candidates.sparkSession.createDataFrame([], candidates.select(post, entity).schema.add("_known", "double"))
    joined = rest.join(known, [post, entity], "left").join(posts.select(post, F.substring(text, 1, limit).alias("_text")), post, "left").join(names.select(entity, F.col(name).alias("_name")), entity, "left")
    # Fixed value: the question that is asked of each post.
    question = F.concat(F.lit("Does this post reference or mention "), F.coalesce("_name", entity), F.lit("?"))
    missing = F.col("_text").isNull() | (F.col("_text") == "") if need_text else F.lit(False)
    scored = joined.withColumn("confidence", F.coalesce("_known", F.when(~missing, sigmoid(logit(question, F.col("_text")))), F.lit(0.0)))
    refused = F.col("_known").isNull() & missing
    judged = scored.select(post, entity, ((F.col("confidence") >= threshold) & ~refused).alias("is_reference"), "confidence", F.lit("").alias("inferred_alias"), (F.col("match_type").isin(*OBLIQUE) & ~refused).alias("is_oblique"), F.col("match_type").alias("source_stage"), F.when(~refused, F.col("alias_matched")).alias("alias_matched"))
    new = scored.where(F.col("_known").isNull() & ~missing & F.col("match_type").isNotNull()).select(post, entity, F.lit(model).alias("model_name"), "confidence").distinct()
    return sure.unionByName(judged).select(shape), new


def accepted(mentions: DataFrame, threshold: float = 0.5) -> DataFrame:
    return mentions.where(F.col("is_reference") & (F.col("confidence") >= threshold))


def bootstrap_aliases(entity_posts: DataFrame, base_posts: DataFrame, entity: str = "entity_id", text: str = "body_clean", least_posts: int = 3, n: int = 30) -> DataFrame:
    """(entity, term, score): the n words most particular to an entity's posts, by the share of its posts times log inverse base frequency."""
    sizes = entity_posts.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    words = entity_posts.select(entity, F.explode(F.array_distinct(T.tokens(F.col(text), 3))).alias("term")).groupBy(entity, "term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_posts)
    base = base_posts.select(F.explode(F.array_distinct(T.tokens(F.col(text), 3))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("base_df"))
    total = base_posts.select(F.count(F.lit(1))).scalar()
    joined = words.join(sizes, entity).join(base, "term", "left")
    score = F.col("df") / F.col("_n") * F.log((total + 1) / (1 + F.coalesce("base_df", F.lit(0))))
    return top_per_key(joined.select(entity, "term", F.bround(score, 4).alias("score")), entity, [F.col("score").desc(), F.col("term")], n)
