"""Queries of the corpus operators for the driver contract, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.tokens import token_output

    return token_output(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.pii import pii_spans

    return pii_spans(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.common import materialize
    from panelspark.llm.mixing import mix_sources, word_count

    sized = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.linededup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"), every=True)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.langid import language_of

    return language_of(table(spark, sf_dir, "documents"))


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.maxscore import topk_search

    return topk_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.substr import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_secrets, op3_simhash, op4_token_output, op5_pii, op6_mixing, op7_line_dedup, op8_language_id, op9_maxscore, op10_substring_dedup, pipeline)}


OP1_SQL = r"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, 10 AS size, array_to_string(ws[i:i + 9], ' ') AS k FROM (SELECT item, ws, unnest(range(1, len(ws) - 8)) AS i FROM item WHERE len(ws) >= 10)
  UNION SELECT item, len(ws), array_to_string(ws, ' ') FROM item WHERE len(ws) BETWEEN 1 AND 9),
doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
runs AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS k FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM win) WHERE len(ws) >= size)),
met AS (SELECT r.doc_id, r.i, r.size, w.item FROM runs r JOIN win w ON w.k = r.k AND w.size = r.size),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM met) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM met GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN words w ON w.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id != q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

OP10_SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM doc WHERE len(ws) >= 13)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT w.doc_id, unnest(range(i, i + 13)) AS p FROM win w JOIN least l ON l.k = w.k WHERE w.doc_id > l.m)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM doc),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM word w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p WHERE g.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM doc d LEFT JOIN kept k ON k.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op9_maxscore": OP9_SQL, "op10_substring_dedup": OP10_SQL}
