"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, jaccard, langid, linededup, mixing, packing, pages, pitmanyor, quality, secrets


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(_read(spark, sf_dir, "documents"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_read(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_read(spark, sf_dir, "documents")).select("doc_id", "n_links", "component_id", "kept")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_dedup(_read(spark, sf_dir, "embeddings"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan_secrets(_read(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn_rules(docs, _read(spark, sf_dir, "labels"))
    got = quality.judge(docs, rules)
    base = [F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return got.select("doc_id", *base, "base_failed", "rule", "kept")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score(_read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_html_main_text, op3_ngram_jaccard_join, op4_embedding_near_dedup, op5_mix_sources, op6_line_dedup, op7_secret_scan, op8_quality_rules, op9_lm_scores, op10_best_fit_packing)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
#: From pairs (a, b), both ways: links and the smallest id reachable of every row of ``v`` (id).
_GROUPS = """reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY 1), deg AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT v.id AS {id}, coalesce(deg.n, 0) AS n_links, least(v.id, coalesce(low.b, v.id)) AS component_id, v.id <= coalesce(low.b, v.id) AS kept FROM v LEFT JOIN low ON low.a = v.id LEFT JOIN deg ON deg.a = v.id"""

ORACLE_SQL: dict[str, str] = {
    # all pairs that share a 5-gram, counted exactly
    "op3_ngram_jaccard_join": f"""WITH RECURSIVE v AS (SELECT doc_id AS id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
g AS (SELECT id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS gram FROM v),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1), c AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.id <> y.id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n s ON s.id = a JOIN n t ON t.id = b WHERE k >= 0.8::DOUBLE*(s.n + t.n - k) - 1e-9),
{_GROUPS.format(id="doc_id")}""",
    "op4_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.label = y.label AND len(x.e) = len(y.e) AND x.id <> y.id AND x.norm > 0 AND y.norm > 0 AND list_dot_product(x.e, y.e)/(x.norm*y.norm) >= 0.93::DOUBLE),
{_GROUPS.format(id="vec_id")}""",
    # targets by trying every level of the water; the queue by one running sum
    "op5_mix_sources": f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0:' || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM s),
r AS (SELECT *, 3.0::DOUBLE*source_size/weight AS ratio FROM w),
l AS (SELECT c.ratio AS level, min(total) - sum(CASE WHEN r.ratio <= c.ratio THEN 3*source_size ELSE 0 END) AS rest, sum(CASE WHEN r.ratio > c.ratio THEN weight ELSE 0 END) AS weights, min(CASE WHEN r.ratio > c.ratio THEN r.ratio END) AS next
  FROM r, (SELECT DISTINCT ratio FROM r UNION ALL SELECT -1.0) c GROUP BY 1),
b AS (SELECT * FROM l WHERE weights > 0 AND rest::DOUBLE/weights >= level AND rest::DOUBLE/weights < next ORDER BY level LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN CAST(3*source_size AS DOUBLE) ELSE weight::DOUBLE*rest::DOUBLE/weights::DOUBLE END AS target FROM r, b),
q AS (SELECT d.*, source_size, target, row_number() OVER o AS n, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY d.source ORDER BY k, doc_id, size)),
x AS (SELECT q.*, c, CAST(cum + c*source_size AS DOUBLE)/target AS finish FROM q, range(0, 3) z(c) WHERE size > 0),
y AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, k, doc_id, n, c ROWS UNBOUNDED PRECEDING) - size AS before FROM x),
e AS (SELECT doc_id, source, k, n, CAST(sum(size) AS BIGINT) AS taken FROM y WHERE before < (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(e.taken, 0) AS taken FROM q LEFT JOIN e ON q.doc_id IS NOT DISTINCT FROM e.doc_id AND q.source IS NOT DISTINCT FROM e.source AND q.n = e.n AND q.k = e.k""",
}
