import datetime as dt
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import affect, curation, mentions, relational, scoring, temporal, vectors
from tidemark.sources import tables
from tidemark.streaming import daily


def test_intensity_share(spark):
    d = dt.date(2024, 1, 1)
    counts = spark.createDataFrame([("a", d + dt.timedelta(days=k), n, 100) for k, n in ((0, 5), (3, 6), (7, 7), (8, 50))], "entity_id string, date date, mention_count long, total_posts long")
    cases = spark.createDataFrame([("a", d), ("b", d), ("c", None)], "entity_id string, event_date date")
    rows = {r.entity_id: r for r in temporal.intensity(counts, cases).collect()}
    assert rows["a"].intensity == pytest.approx(18 / 300) and rows["b"].intensity == 0.0 and "c" not in rows


def test_power_law():
    assert temporal.power_law([1, 2, 4], 10, 1).tolist() == [10, 5, 2.5]
    tau = np.arange(1, 60.0)
    c, alpha, _ = temporal.fit_power_law(tau, 100 * tau**-0.7)
    assert c == pytest.approx(100, rel=1e-6) and alpha == pytest.approx(0.7, abs=1e-6)
    assert temporal.fit_power_law(tau, tau)[1] == pytest.approx(0.01, abs=1e-6)


def test_decay_needs_days(spark):
    d = dt.date(2024, 1, 1)
    counts = spark.createDataFrame([("a", d + dt.timedelta(days=k), int(1000 / k), 5) for k in range(1, 40)] + [("b", d, 1, 1)], "entity_id string, date date, mention_count long, total_posts long")
    cases = spark.createDataFrame([("a", d), ("b", d), ("z", d)], "entity_id string, event_date date")
    rows = {r.entity_id: r for r in temporal.fit_decay(counts, cases).collect()}
    assert rows["a"].fit_success and rows["a"].alpha == pytest.approx(1, abs=0.02)
    assert not rows["b"].fit_success and rows["b"].longevity is None and rows["z"].n_days == 0


@pytest.fixture
def posts(spark):
    rows = [(1, "the john smithson case"), (2, "j0hn sm1thson again"), (3, "smithsen was named"), (4, "nothing here"), (5, None), (6, "")]
    return spark.createDataFrame(rows, "post_id long, body_clean string")


def test_mention_passes(spark, posts):
    cases = spark.createDataFrame([("E1", "John Smithson", "jsm; ; none"), ("E2", None, None)], "entity_id string, name string, aliases string")
    table = mentions.aliases(cases)
    assert {(r.alias, r.source) for r in table.collect()} == {("John Smithson", "name"), ("Smithson", "last_name"), ("jsm", "aliases")}
    found = {r.post_id: r.match_type for r in mentions.lexical_candidates(posts, table).collect()}
    assert found == {1: "exact_substring", 2: "adversarial_norm", 3: "phonetic_skeleton"}
    fuzzy = mentions.fuzzy_mentions(posts, table).where("post_id = 3").collect()
    assert fuzzy[0].alias_matched == "smithsen" and fuzzy[0].score == pytest.approx(14 / 16)
    assert mentions.exact_mentions(posts, table, least=99).count() == 0


def test_many_patterns_take_the_join(spark, posts):
    table = spark.createDataFrame([("E", "smithson"), ("F", "named")], "entity_id string, alias string")
    a = sorted(map(tuple, mentions.exact_mentions(posts, table).collect()))
    assert a == sorted(map(tuple, mentions.exact_mentions(posts, table, most_aliases=1).collect())) and len(a) == 2


def test_adjudication_uses_the_cache(spark, posts):
    kind = "post_id long, entity_id string, alias_matched string, match_type string, score double"
    found = spark.createDataFrame([(1, "E", "x", "exact_substring", 1.0), (2, "E", "y", "semantic", 0.4), (4, "E", "z", "fuzzy", 0.9), (5, "E", "w", "fuzzy", 0.9)], kind)
    names = spark.createDataFrame([("E", "name")], "entity_id string, name string")
    cache = spark.createDataFrame([(4, "E", "m", 0.1)], "post_id long, entity_id string, model_name string, confidence double")
    rows, new = mentions.adjudicate(found, posts, names, lambda q, x: F.lit(2.0), "m", cache=cache)
    by = {r.post_id: r for r in rows.collect()}
    assert by[1].confidence == 1.0 and by[1].is_reference
    assert by[2].is_oblique and by[2].confidence == pytest.approx(1 / (1 + math.exp(-2)))
    assert not by[4].is_reference and by[4].confidence == 0.1
    assert by[5].confidence == 0.0 and by[5].alias_matched is None and not by[5].is_oblique
    assert [r.post_id for r in new.collect()] == [2]


def test_affect_and_scores(spark):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "entity_id string, post_id long")
    labels = spark.createDataFrame([(1, "positive"), (2, "positive"), (3, "neutral"), (4, "negative")], "post_id long, label string")
    ratios = scoring.affect_ratios(m, labels)
    assert {r.entity_id: r.positive_ratio for r in ratios.collect()} == {"a": pytest.approx(2 / 3), "b": 0.0}
    temporal_ = spark.createDataFrame([("a", 0.5, 2.0), ("c", 0.5, 2.0)], "entity_id string, intensity double, longevity double")
    semantic = spark.createDataFrame([], "entity_id string, similarity_median double")
    rows = {r.entity_id: r for r in scoring.naive_score(ratios, temporal_, semantic).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["c"].positive_ratio == 0.5 and rows["a"].similarity_median_scaled == 0.5


def test_hdi_and_models(spark):
    low, high = scoring.hdi(np.linspace(0, 1, 1001) ** 2)
    assert low == 0 and high == pytest.approx(0.89**2, abs=0.01)
    rng = np.random.default_rng(1)
    factor = rng.normal(size=80)
    x = factor[:, None] * [1, 1, 0.8, 0.9, 1] + 0.3 * rng.normal(size=(80, 5))
    draws = scoring.factor_score(x, 300, 200, 2, positive_loadings=True)
    assert np.corrcoef(draws.mean(axis=0), factor)[0, 1] > 0.95
    group = np.arange(80) % 4
    table = scoring.fit_regression(factor[:, None], 2 * factor + rng.normal(size=80) * 0.1, group, ["x"], 300, 200, 2)
    assert table[1]["hdi_low"] < 2 < table[1]["hdi_high"] + 0.1


def test_similarity_and_clusters(spark):
    rows = [("same", i, [1.0, 0.0, 0.0]) for i in range(10)] + [("one", 100, [1.0, 0.0, 0.0])] + [("apart", 200 + i, np.eye(5)[i].tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "e string, i long, v array<double>")
    found = {r.e: r for r in vectors.similarity_stats(df, "e", "i", "v").collect()}
    assert found["same"].similarity_median == pytest.approx(1) and found["one"].similarity_median == 0 and found["one"].n == 1 and found["apart"].similarity_mean == 0
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2)), [[100, 0], [0, 100], [-100, 0], [0, -100.0]]])
    labels = vectors.density_clusters(x, 15)
    assert len(set(labels[:40])) == 1 and len(set(labels[40:80])) == 1 and labels[0] != labels[40] and set(labels[80:]) == {-1}
    assert [tuple(r)[1:] for r in vectors.topic_concentration(df, "e", "i", "v").where("e = 'one'").collect()] == [(0, 0.0, 1.0)]


@pytest.mark.parametrize(("day", "window"), [(-1, None), (0, 0), (29, 0), (30, 1), (749, 24), (750, None)])
def test_drift_window_edges(spark, day, window):
    rows = [("a", i, day, [1.0, float(i)]) for i in range(5)]
    df = spark.createDataFrame(rows, "entity_id string, post_id long, days int, embedding array<double>")
    assert [r.window for r in vectors.drift_windows(df, 2).collect()] == ([] if window is None else [window])


def test_curation(spark):
    cases = spark.createDataFrame([("A", "Y (why)", "2001-05", "12 (3)", "1;2"), ("B", "N+x", "n/a", None, " ; ")], "id string, flag string, day string, n string, l string")
    clean = curation.normalise(cases, ints=["n"], dates=["day"])
    rows = {r.id: r for r in curation.enforce_domains(clean, {"flag": ["Y", "N"]}).collect()}
    assert (rows["A"].flag, rows["A"].flag_detail, rows["A"].day, rows["A"].n) == ("Y", "why", "2001-05-01", 123)
    assert (rows["B"].flag, rows["B"].flag_detail, rows["B"].day) == ("N", "+x", None)
    assert [tuple(r) for r in curation.list_rows(cases, "id", "l").collect()] == [("A", 0, "1"), ("A", 1, "2")]
    assert {tuple(r) for r in curation.missing_required(clean, "id", ["n", "gone"]).collect()} == {("A", "gone"), ("B", "n"), ("B", "gone")}
    edges = spark.createDataFrame([(1, "AB-1999-X", "[someone]"), (2, "AB-2005-Y", "A")], "edge_id long, s string, t string")
    assert {(r.ref, r.kind) for r in curation.dangling_refs(edges, cases, "edge_id", ["s", "t"], "id").collect()} == {("AB-1999-X", "before_table"), ("[someone]", "placeholder"), ("AB-2005-Y", "dangling")}
    facts = spark.createDataFrame([("A", 1, 2, "N", 0, 2001, dt.date(2002, 1, 1), "F", "N", "x")], "id string, total int, excl int, died string, cas int, year int, day date, status string, manifesto string, m1 string")
    rules = curation.case_rules("total", "excl", "died", "cas", "year", "day", "status", "manifesto", ["m1"])
    assert curation.rule_violations(facts, "id", rules).count() == 6


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("# t\n### AB-2001-X\n- name: one\n- name: two\nnoise\n### other\n- name: lost\n### NET-1\n- k: v: w\n")
    rows = {r.record: r.fields for r in tables.markdown_records(spark, str(tmp_path / "a.md")).collect()}
    assert rows == {"AB-2001-X": {"name": "two"}, "NET-1": {"k": "v: w"}}
    (tmp_path / "b.md").write_text("x\n| # | a | b | c |\n|---|---|---|---|\n| 1 | p | q | r |\n| 2 | s |\nend\n| 9 | n | o | t |\n")
    assert [r.cells for r in tables.markdown_table(spark, str(tmp_path / "b.md")).collect()] == [["1", "p", "q", "r"]]
    (tmp_path / "c.md").write_text("### High cases\n- AB-2001-X\n### Unknown\n- AB-2002-Y\n")
    assert [tuple(r) for r in tables.markdown_sections(spark, str(tmp_path / "c.md"), {"high": "H"}).collect()] == [("H", "AB-2001-X")]


def test_posts_from_archive(spark, tmp_path):
    width = tables.POST_WIDTH
    rows = []
    for post, stamp, text in (("7", "1420070400", ">>5 &gt;hello <b>World</b>\nsecond"), ("x", "1420070400", "a"), ("8", "1", "b")):
        row = ["\\N"] * width
        row[0], row[2], row[4], row[22] = post, "5", stamp, text
        rows.append(row)
    import csv

    with open(tmp_path / "p.csv", "w", newline="") as f:
        csv.writer(f).writerows([*rows, ["9", "short"]])
    with tarfile.open(tmp_path / "p.tar.gz", "w:gz") as t:
        t.add(tmp_path / "p.csv", "p.csv")
    found = tables.parse_posts(tables.read_archives(spark, [str(tmp_path / "p.tar.gz")]), "b").collect()
    assert len(found) == 1 and found[0].post_id == 7 and found[0].reply_to == [5] and found[0].body_clean == "5 >hello world second" and found[0].year == 2015
    df = spark.createDataFrame([(1, 2015, 1), (2, 2015, 2), (3, 2016, 1)], "i long, year int, month int")
    assert tables.write_partitioned(df, str(tmp_path / "out"), ["year", "month"]) == 3
    assert tables.read_parquet(spark, str(tmp_path / "out"), ["i", "year"]).count() == 3
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), infer=True).count() == 3
    assert tables.file_hashes(spark, str(tmp_path / "p.csv")).first().length > 0
    log = tables.RunLog("x", Settings())
    log.add("inputs", str(tmp_path / "p.csv"))
    log.write(str(tmp_path / "log/run.json"))
    assert (tmp_path / "log/run.json").exists()


def test_affect_scorers(spark, posts):
    s = affect.LexiconScorer({"negative": ["nothing"], "neutral": [], "positive": ["case"]})
    rows = {r.post_id: r for r in affect.score_affect(posts, s, affect.LexiconScorer({"Big Joy": ["case"]}), affect.LexiconScorer({"toxic": []})).collect()}
    assert rows[1].sentiment_label == "positive" and rows[4].sentiment_label == "negative" and rows[6].sentiment_label == "negative" and rows[1].emotion_big_joy == 1.0


def test_plans(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    assert "WindowGroupLimit" in relational.top_per_key(df, "k", [F.col("id")], 5)._jdf.queryExecution().toString()
    assert "LeftSemi" in relational.members(df, df, "id")._jdf.queryExecution().toString()


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 5)), ("a", dt.datetime(2024, 1, 1, 6)), ("b", dt.datetime(2024, 1, 5))], "entity_id string, timestamp_utc timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = daily.daily_counts_stream(stream).writeStream.outputMode("complete").format("memory").queryName("daily_out").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.entity_id, r.mention_count) for r in spark.table("daily_out").collect()} == {("a", 2), ("b", 1)}


def test_settings(monkeypatch, tmp_path):
    (tmp_path / "c.toml").write_text("seed = 5\nwindow_days = 10\n")
    monkeypatch.setenv("TIDEMARK_SEED", "7")
    s = Settings.load(tmp_path / "c.toml")
    assert (s.seed, s.window_days, Settings().seed, Settings.load(seed=9).seed) == (7, 10, 42, 9)


def test_many_names_and_centres_take_the_same_rows(spark):
    posts = spark.createDataFrame([(1, "a word alphq here", [1.0, 0.0]), (2, "nothing", [0.0, 1.0]), (3, "alpha", [0.6, 0.8])], "post_id long, body_clean string, embedding array<double>")
    names = spark.createDataFrame([("x", "Alpha"), ("y", "wordy name")], "entity_id string, alias string")
    probes = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "entity_id string, embedding array<double>")
    rows = lambda df: sorted(map(str, df.collect()))
    few = rows(mentions.fuzzy_mentions(posts, names, threshold=80.0))
    assert few and few == rows(mentions.fuzzy_mentions(posts, names, threshold=80.0, most_names=0))
    near = rows(mentions.centroid_candidates(posts, probes, 2, n=2))
    assert len(near) == 4 and near == rows(mentions.centroid_candidates(posts, probes, 2, n=2, most_centres=0))


def test_queries_use_all_rows_of_large_groups(spark, monkeypatch):
    from tidemark.operators import vectors
    from tidemark.plans import catalogue

    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(300, 6)), np.round(rng.normal(size=(300, 6))), np.ones((200, 6))):
        s = (x @ x.T)[np.triu_indices(len(x), 1)]
        for most in (50_000_000, 100):
            q, mean, deviation = vectors.pair_stats(x, most=most, bins=8, block=64)
            assert np.allclose(q, np.percentile(s, [25, 50, 75])) and np.allclose([mean, deviation], [s.mean(), s.std()])
    dim = 4
    monkeypatch.setattr(catalogue, "DIM", dim)
    wide = spark.range(10_300).select((F.col("id") * 750).alias("post_id"), F.lit(1).alias("entity_id"), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: F.sin(k * (F.col("id") + 1)).cast("float")).alias("embedding"))
    monkeypatch.setattr(catalogue, "_vectors", lambda t: wide)
    assert catalogue.QUERIES["drift_windows"](spark, "unused").first()["n_posts"] == 10_300
    assert catalogue.QUERIES["similarity_stats"](spark, "unused").first()["n"] == 10_300
    few = vectors.similarity_stats(wide, "entity_id", "post_id", "embedding", sample=50).first()
    assert few["n"] == 50


def test_lexical_candidates_query_sees_all_posts(spark, monkeypatch):
    from tidemark.plans import catalogue

    posts = spark.createDataFrame([(k, "the kovalenkko case") for k in range(1, 7)], "post_id long, body_clean string")
    names = spark.createDataFrame([("e", "kovalenko")], "entity_id string, alias string")
    seen = lambda **o: {r.post_id for r in mentions.lexical_candidates(posts, names, **o).collect()}
    assert seen(sample_target=2) < seen(sample_target=None) == set(range(1, 7))
    asked = []
    monkeypatch.setattr(catalogue.mentions, "lexical_candidates", lambda *a, **o: asked.append(o))
    try:
        catalogue.QUERIES["lexical_candidates"](spark, "/root/testdata/sf0.001")
    except AttributeError:  # what the query makes of nothing
        pass
    assert asked == [{"sample_target": None}]


def test_overrides_keep_every_append(spark):
    cases = spark.createDataFrame([("a", "1", None, 5), ("b", "", "x", None), ("c", "y", "z", 7)], "id string, l string, f string, n int")
    rows = [("a", "l", "append", "x", 1), ("a", "l", "append", "y", 2), ("a", "l", "append", "1", 3), ("a", "f", "fill", "p", 1), ("a", "f", "fill", "q", 2), ("a", "n", "set", "9", 1), ("b", "l", "append", "z", 1), ("b", "f", "fill", "no", 1), ("b", "n", "fill", "3", 1), ("b", "f", "set", None, 1), ("z", "l", "set", "lost", 1)]
    changes = spark.createDataFrame(rows, "id string, field string, mode string, value string, at int")
    got = {r.id: tuple(r)[1:] for r in curation.apply_overrides(cases, changes, "id", "at").collect()}
    assert got == {"a": ("1; x; y", "p", 9), "b": ("z", "x", 3), "c": ("y", "z", 7)}
    assert curation.apply_overrides(cases, changes.limit(0), "id").schema == cases.schema
    plan = curation.apply_overrides(cases, changes, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_model_adapters(spark):
    from tidemark.functions import udfs

    class Counting:
        def embed(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

        def score(self, questions, texts):
            return [len(q) - len(t) for q, t in zip(questions, texts, strict=True)]

    df = spark.createDataFrame([(1, "abc", "q"), (2, "", "qq"), (3, None, "q"), (4, "x", None)], "i int, t string, q string").repartition(2)
    got = {r.i: (r.v, r.s) for r in df.select("i", udfs.embedding(Counting, batch=1)("t").alias("v"), udfs.pair_logit(Counting)("q", "t").alias("s")).collect()}
    assert got[1][0] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)], rel=1e-6) and got[2][0] is None and got[3][0] is None
    assert (got[1][1], got[2][1], got[3][1], got[4][1]) == (-2.0, 2.0, None, None)
    assert (udfs.batch_rows(10**9, 10**6), udfs.batch_rows(0, 5), udfs.batch_rows(33, 1, 16)) == (512, 1, 16)


def test_sampler_diagnostics_and_tables(spark, tmp_path):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(4, 500, 1))
    slow = np.cumsum(rng.normal(size=(4, 500, 1)), axis=1)
    r, ess = scoring.diagnostics(np.concatenate([good, slow], axis=2))
    assert r[0] < 1.01 < 1.1 < r[1] and ess[0] > 1500 > 100 > ess[1]
    rows = [(k, float(2 * x + 0.1 * e), x, k % 3) for k, (x, e) in enumerate(rng.normal(size=(60, 2)).tolist())] + [(99, None, 1.0, 0)]
    design = spark.createDataFrame(rows, "entity_id int, score double, x double, group_index int")
    found = {r.term: r for r in scoring.regression(design, "score", ["x"], draws_path=str(tmp_path / "draws"), samples=300, tune=200, chains=2).collect()}
    assert set(found) == {"intercept", "x"} and found["x"].hdi_low < 2 < found["x"].hdi_high + 0.05 and found["x"].r_hat < 1.1 and found["x"].ess_bulk > 50
    draws = spark.read.parquet(str(tmp_path / "draws"))
    assert draws.count() == 2 * 300 * 2 and draws.where("term = 'x'").agg(F.avg("value")).first()[0] == pytest.approx(found["x"].mean)
    assert scoring.regression(design.limit(0), "score", ["x"]).count() == 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(scoring, "MOST_ENTITIES", 10)
        with pytest.raises(ValueError, match="up to 10 entities"):
            scoring.regression(design, "score", ["x"])


def test_clusters_use_all_rows(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.1, (3000, 2)), rng.normal(5, 0.1, (3000, 2))])
    df = spark.createDataFrame([("e", k, v) for k, v in enumerate(x.tolist())], "e string, i long, v array<double>")
    found = vectors.topic_concentration(df, "e", "i", "v").first()
    labels = vectors.density_clusters(x)
    assert found.noise_proportion == pytest.approx((labels < 0).mean()) and found.top3_proportion <= 1.0
    assert vectors.topic_concentration(df, "e", "i", "v", sample=29).first().n_clusters == 0
    every = vectors.semantic_metrics(df.withColumn("t", F.lit("some words here")), "e", "i", "v", "t", sample=50).first()
    assert every.n == 50 and every.entropy == pytest.approx(math.log2(3)) and every.n_clusters == found.n_clusters


def test_patterns_in_blocks_and_literal_words(spark):
    posts = spark.createDataFrame([(1, "say a.b\\ec now"), (2, "say axb now"), (3, "a.b\\ecx")], "post_id long, body_clean string")
    names = spark.createDataFrame([("E", "a.b\\Ec"), ("F", "nows"), ("G", "now")], "entity_id string, alias string")
    assert {(r.post_id, r.entity_id) for r in mentions.exact_mentions(posts, names, least=3, word_boundary=True).collect()} == {(1, "E"), (1, "G"), (2, "G")}
    many = spark.createDataFrame([(f"E{k}", f"word{k}x") for k in range(40)], "entity_id string, alias string")
    texts = spark.createDataFrame([(k, f"the word{k}x and word{k + 1}x") for k in range(39)], "post_id long, body_clean string")
    few = sorted(map(tuple, mentions.exact_mentions(texts, many).collect()))
    assert len(few) == 78 and few == sorted(map(tuple, mentions.exact_mentions(texts, many, most_aliases=7).collect()))


def test_retrieval_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 5)), 1)
    x[200:250] = x[:50]  # ties
    posts = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())] + [(900, None)], "post_id long, embedding array<double>").repartition(5)
    probes = spark.createDataFrame([(f"e{k % 6}", v) for k, v in enumerate(rng.normal(size=(18, 5)).tolist())], "entity_id string, embedding array<double>")
    centres = {r.entity_id: np.array(r.centroid) for r in mentions.vector_mean(probes, "entity_id", "embedding", 5).collect()}
    want = {(e, k) for e, c in centres.items() for k in sorted(range(300), key=lambda i: (-round(float(x[i] @ c / np.linalg.norm(c)), 12), i))[:20]}
    for most in (10_000, 2):
        assert {(r.entity_id, r.post_id) for r in mentions.centroid_candidates(posts, probes, 5, n=20, most_centres=most).collect()} == want
    threads = posts.withColumn("thread_id", F.floor(F.col("post_id") / 10))
    few = mentions.thread_candidates(threads, posts.where("post_id = 15"), probes, 5, n=50, most_posts=4)
    assert few.select("post_id").distinct().count() == 4 and few.where("post_id not between 10 and 19").count() == 0


def test_manifest_log_and_rotation(spark, tmp_path):
    import logging

    from tidemark import logs

    df = spark.createDataFrame([(dt.datetime(2020, 1, 2), 1, "ab"), (dt.datetime(2020, 1, 3), 1, "abcd"), (dt.datetime(2020, 2, 1), 2, "x")], "timestamp_utc timestamp, thread_id long, body string")
    tables.write_parquet(df, str(tmp_path / "posts"))
    record = tables.manifest_record(df, str(tmp_path / "posts"), str(tmp_path / "m" / "manifest.json"))
    assert record["total"] == 3 and [m["n_posts"] for m in record["months"]] == [2, 1] and all(len(f["sha256"]) == 64 for f in record["files"]) and (tmp_path / "m" / "manifest.json").exists()
    one = str(next((tmp_path / "posts").glob("*.parquet")))
    plain, spread = tables.RunLog("x"), tables.RunLog("x")
    plain.add("inputs", one)
    spread.add("inputs", one, spark)
    assert plain.record["inputs"] == spread.record["inputs"]
    log = logs.setup_logging(str(tmp_path / "logs" / "run.log"), most_bytes=200, kept=2)
    for k in range(20):
        log.info("line %d", k)
    logs.setup_logging(str(tmp_path / "logs" / "run.log"))
    assert (tmp_path / "logs" / "run.log.1").exists() and len(logging.getLogger("tidemark").handlers) == 2


def test_scores_beside_each_other(spark):
    naive = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", 4.0)], "entity_id string, score_naive double")
    bayes = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", None)], "entity_id string, score_bayes double")
    assert [r.entity_id for r in scoring.compared_scores(naive, bayes).collect()] == ["a"]
    top = scoring.compared_scores(naive, bayes, naive.where("entity_id <> 'd'"), ranked=5).orderBy("rank").collect()
    assert [(r.entity_id, r.rank) for r in top] == [("b", 1), ("a", 2), ("c", 3)]
    draws = spark.createDataFrame([(1, v) for v in [3.0, 1.0, 2.0, 9.0, None]] + [(2, 5.0)], "k int, v double")
    assert {tuple(r) for r in scoring.hdi_per_key(draws, "k", "v", 0.5).collect()} == {(1, 1.0, 3.0), (2, 5.0, 5.0)}


def test_factor_draws_stay_off_the_driver(spark, tmp_path):
    import tracemalloc

    n, options = 1100, {"samples": 500, "tune": 20, "chains": 2}
    x = np.random.default_rng(3).normal(size=(n, 5))
    x += x[:, :1]
    features = spark.createDataFrame([(k, *row) for k, row in enumerate(x.tolist())], "entity_id long, " + ", ".join(f"z_{c} double" for c in scoring.INDICATORS))
    tracemalloc.start()
    rows = sorted(scoring.bayes_score(features, draws_path=str(tmp_path / "draws"), **options).collect())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    draws = scoring.factor_score(x, **options)
    assert peak < draws.nbytes / 2  # all draws are 8.8 MB
    assert np.allclose([r.score_bayes for r in rows], draws.mean(axis=0)) and np.allclose([(r.hdi_low, r.hdi_high) for r in rows], [scoring.hdi(d) for d in draws.T])
    assert np.allclose([(r.r_hat, r.ess_bulk) for r in rows], np.transpose(scoring.diagnostics(draws.reshape(2, 500, n))))
    stored = spark.read.parquet(str(tmp_path / "draws"))
    assert stored.count() == draws.size and [r.value for r in stored.where("entity_id = 700").orderBy("chain", "draw").collect()] == pytest.approx(draws[:, 700].tolist())


def test_regression_takes_more_rows_than_a_driver_gathers(spark):
    k = F.col("id")
    design = spark.range(100_100).select(k.alias("entity_id"), (k % 7).cast("double").alias("x"), (k % 3 * 2).cast("int").alias("group_index"), (k % 7 * 0.5 + F.sin(k * 1.3) + k % 3).alias("score"))
    options = {"samples": 100, "tune": 50, "chains": 2}
    found = scoring.regression(design, "score", ["x"], **options).toPandas()
    rows = design.orderBy("group_index", "score").toPandas()
    draws = scoring.regression_draws(rows[["x"]].to_numpy(float), rows["score"].to_numpy(), rows["group_index"].to_numpy(), **options)
    assert np.allclose(found["mean"], draws.mean(axis=0)) and np.allclose(found["hdi_low"], [scoring.hdi(d)[0] for d in draws.T])


@pytest.mark.parametrize("name", ["adjudicate", "cache_antijoin", "accepted"])
def test_adjudication_of_odd_documents_matches_sql(spark, tmp_path, name):
    import duckdb

    from tidemark.plans import catalogue

    texts = [None, "", "a", "word " * 80, "x" * 600]
    rows = [(10 * i + j, t, lang, f"s{i}") for i, lang in enumerate(["en", "fr", "de", None]) for j, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 10 == 3)) for k, *_ in rows if k % 2], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    theirs = db.execute(f"select {', '.join(found.columns)} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, theirs)) == sorted(str(tuple(r)) for r in found.collect())


def test_nested_clusters_take_memory_of_their_points():
    import tracemalloc

    at = np.arange(5000.0) ** 2  # each pair joins all before it: 5,000 clusters, one in the other
    x = np.stack([np.concatenate([at, at + 0.5])], axis=1)
    tracemalloc.start()
    labels = vectors.density_clusters(x, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == 10_000 and peak < 180e6  # the points of all clusters are 25 million


def test_markdown_in_splits_keeps_order_and_headers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LINES", 40)
    text = "".join(f"### AB-2001-{k}\n- v: old\r\n- v: {k}  \nnoise\n" + ("### Other\n- v: lost\n" if k % 3 == 0 else "") + "x\n" * (60 if k % 50 == 0 else 0) for k in range(600))
    for name in ("a.md", "b.md"):
        (tmp_path / name).write_text(text, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = tables._lines(spark, str(tmp_path)).persist()
        assert lines.rdd.getNumPartitions() > 1 and spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 4
        rows = tables.markdown_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = [line.rstrip("\r").rstrip(" ") for line in text.split("\n")[:-1]]
    for f in {r.file for r in lines.select("file").distinct().collect()}:
        assert [(r.line, r.text) for r in lines.where(F.col("file") == f).orderBy("line").collect()] == list(enumerate(expected))
    places = [k for k, line in enumerate(expected) if line.startswith("### AB")]
    assert sorted((r.file, r.ordinal, r.record, r.fields["v"]) for r in rows) == [(f, p, f"AB-2001-{k}", str(k)) for f in sorted({r.file for r in rows}) for k, p in enumerate(places)]
    assert len(rows) == 1200
    # no value holds a file
    seen = []
    monkeypatch.setattr(spark.read.__class__, "text", lambda self, paths, wholetext=False, f=spark.read.__class__.text, **k: seen.append(wholetext) or f(self, paths, wholetext=wholetext, **k))
    tables.markdown_table(spark, str(tmp_path / "a.md")).count()
    assert seen == [False]


def test_lexical_passes_send_short_batches(spark, posts):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    table = spark.createDataFrame([("E", "smithson")], "entity_id string, alias string")
    try:
        for run in (lambda: mentions.exact_mentions(posts, table), lambda: mentions.lexical_candidates(posts, table, sample_target=None)):
            spark.conf.set(name, "10000")
            assert {r.post_id for r in run().collect()} >= {1} and int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, old)
