"""The queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm import brown

    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 5) == 1
    return brown.score(docs, train=~held).withColumn("held_out", fold("doc_id", 5) == 1).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm import toxicity

    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=fold("doc_id", 5) != 0)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "windows", "toxic_windows")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm import html

    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "blocks", "kept")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm import jaccard

    return jaccard.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    from veriframe.llm import pieces

    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode_decode(table(spark, sf_dir, "documents"), model_path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm import langid

    found = langid.identify(table(spark, sf_dir, "documents"), train=fold("doc_id", 4) != 2)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.concat_ws(",", "languages").alias("languages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm import quality

    ranked = quality.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=fold("doc_id", 3) != 1)
    return ranked.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "rank_score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm import sharding

    return sharding.shard(table(spark, sf_dir, "documents"), shards=8, law="rows")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm import decontamination

    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm import fingerprints

    found = fingerprints.fingerprint(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm import oddsketch

    return oddsketch.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm import search

    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_toxicity, op3_html_extraction, op4_ngram_jaccard, op5_sentencepiece, op6_language_id, op7_quality, op8_sharding, op9_decontamination, op10_fingerprints,
        op11_source_divergence, op12_minhash_dedup, op13_ranked_search,
    )
}

# Words of the lower-cased texts, shingles of five words, all pairs that share one, and what links reach.
_LINKED = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {least} * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id{more} FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""



def _components(k: int, least: int, more: str = "") -> str:
    return _LINKED.replace("{k}", str(k)).replace("{least}", str(least)).replace("{more}", more)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Terms that at least 30 documents of a language hold, their shares by group and by language, all pairs of groups over all terms.
_DIVERGENCE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT doc_id, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term
), o AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS own FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), p AS (
  SELECT o.lang, o.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (o.own + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM o JOIN k ON k.lang = o.lang JOIN l ON l.lang = o.lang LEFT JOIN c ON c.lang = o.lang AND c.source = o.source AND c.term = k.term
), x AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""

# Scores of all documents that share a term with an item.
_SEARCH = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0
), q AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term
), t AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term
), f AS (
  SELECT term, count(*) AS df FROM t GROUP BY term
), i AS (
  SELECT t.doc_id, t.term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / (2 * f.df + 1))) AS BIGINT) * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * t.n * s.n) // s.l))) AS impact FROM t JOIN f ON f.term = t.term CROSS JOIN s
), z AS (
  SELECT q.item_id, i.doc_id, sum(q.times * i.impact) AS score FROM q JOIN i ON i.term = q.term GROUP BY q.item_id, i.doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM z WHERE score > 0) WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": _components(5, 75),
    "op11_source_divergence": _DIVERGENCE,
    "op12_minhash_dedup": _components(3, 85, ", m.component_id = d.doc_id AS kept"),
    "op13_ranked_search": _SEARCH,
}
