"""One query per operator of this package, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .bloom_lm import lm_scores
from .decision_list import quality_rules
from .entropy_mix import entropy_mix
from .golay import simhash_classes
from .hd_langid import language_id
from .html_blocks import extract_main_text
from .line_chunks import line_chunk_dedup
from .maxscore import top_k
from .slack_packing import slack_packing
from .token_counts import token_counts


def op1_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix(table(spark, sf_dir, "documents"))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunk_dedup(table(spark, sf_dir, "documents"), run_words=50).select("doc_id", "text", "n_lines_removed", "n_chunks_removed")


def op5_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing(table(spark, sf_dir, "documents"))


def op6_hd_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_block_lstm, op2_decision_list, op3_entropy_mix, op4_line_chunks, op5_slack_packing, op6_hd_langid, op7_maxscore, op8_golay_simhash, op9_token_counts, op10_bloom_lm)}

ORACLE_SQL: dict[str, str] = {
    "op7_maxscore": """
        WITH v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
        bad AS (SELECT DISTINCT vec_id FROM (SELECT vec_id, unnest(e) AS x FROM v) WHERE x IS NULL OR NOT isfinite(x)),
        c AS (SELECT vec_id, unnest(range(len(e))) AS i, CAST(floor(256 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x
              FROM v WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
              FROM c AS q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                     vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
