"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, cover_tree, edit_prints, langid, mincut_html, mixing, simhash, suffix_dedup, token_counts, token_files
from .common import shared_folder


def _tokenizers():
    import public_tokenizers

    return public_tokenizers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shares of all tokens that the domains are to have.
QUALITY_TARGETS = {"high": 0.85, "low": 0.1, "toxic": 0.05}


def byte_ranks() -> tuple[str, str]:
    """Rank file and pattern of the byte-level vocabulary."""
    return _tokenizers().path("byte_bpe_50k.tiktoken"), _tokenizers().PATTERN


def quality_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents: toxic, else of high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return _table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=100, digest_only=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(~langid.held_out()))
    found = langid.identify(documents, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return mincut_html.extract(pages, mincut_html.fit(pages))


def op5_mixture_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_rates(_table(spark, sf_dir, "documents"), quality_domains(spark, sf_dir), QUALITY_TARGETS)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), folder, _tokenizers().path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, folder).drop("token_ids")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizers().path("word_bpe_49k.json"), limit=2048)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = byte_ranks()
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, pattern)
    return byte_bpe.decode(encoded, ranks, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_edit_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_prints.with_near_first(edit_prints.fingerprint_and_compare(_table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_embedding_links, op4_html_text, op5_mixture_rates, op6_token_files, op7_token_counts, op8_byte_bpe, op9_edit_prints, op10_simhash)}

_REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d)),
f AS (SELECT doc_id, p, min((doc_id, p)) OVER (PARTITION BY s) AS first FROM w),
gone AS (SELECT doc_id, p FROM f WHERE first <> (doc_id, p)),
island AS (SELECT doc_id, p, sum(CASE WHEN p <= coalesce(before, -1000) + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone)),
span AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM island GROUP BY doc_id, k),
edge AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS removed FROM span GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(len(starts), 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE ends[i] END)::BIGINT + 1, 2 * ((CASE WHEN i = len(starts) THEN n ELSE starts[i + 1] END) - CASE WHEN i = 0 THEN 0 ELSE ends[i] END)::BIGINT)), '') END)) AS kept_sha256
FROM d LEFT JOIN edge USING (doc_id)"""

_LINKS = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
sound AS (SELECT vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
u AS (SELECT vec_id, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS x FROM sound),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) >= 0.95),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, least(vec_id, coalesce(b, vec_id)) = vec_id AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS b FROM r GROUP BY a) USING (vec_id)"""

#: Queries that SQL can state. The others need a classifier, a solver, a tokenizer's merges or a hash that SQL has not; the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": _REPEATS, "op3_embedding_links": _LINKS}
