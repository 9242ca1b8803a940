"""Queries and SQL of the llm operators, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import table
from barloom.llm.leakage import leaks
from barloom.llm.nearest import nearest_match
from barloom.llm.packing import pack, token_counts
from barloom.llm.truncation import truncation_scores
from barloom.session import cut


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_match(
        table(spark, sf_dir, "funding"),
        table(spark, sf_dir, "positioning"),
        left_key="symbol",
        right_key="symbol",
        left_ts="ts",
        right_ts="ts",
        left_id="settlement_id",
        right_id="reading_id",
        right_present="open_interest",
        tolerance_s=600,
    ).select("settlement_id", "reading_id")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document lies when all are packed into the containers of each capacity."""
    sizes = cut(token_counts(table(spark, sf_dir, "documents"), id_col="doc_id", text="text"))
    return pack(sizes, table(spark, sf_dir, "pack_capacities"), id_col="doc_id", size="tokens", pack_id="pack_id", capacity="capacity_tokens")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of room used, by packing."""
    caps = table(spark, sf_dir, "pack_capacities").select("pack_id", "capacity_tokens")
    return (
        p6_pack(spark, sf_dir)
        .groupBy("pack_id")
        .agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
        .join(caps, "pack_id")
        .withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each evaluation passage it repeats, and how much of it."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", passage="passage")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("item_id", "doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the ending of every document looks cut."""
    return truncation_scores(table(spark, sf_dir, "documents"), id_col="doc_id", source="source", text="text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where(F.col("score") >= 0.5).select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    cut = F.col("score") >= 0.5
    return (
        p8_scores(spark, sf_dir)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("records"), F.count_if(cut).alias("truncated"))
        .withColumn("share", F.round(F.col("truncated") / F.col("records"), 6))
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p6_pack": p6_pack, "p6_fill": p6_fill, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_scores": p8_scores, "p8_sources": p8_sources}


P2_SQL = """
WITH l AS (
  SELECT upper(trim(symbol)) AS s, ts, min(settlement_id) AS settlement_id
  FROM funding WHERE symbol IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
r AS (
  SELECT upper(trim(symbol)) AS s, ts, min(reading_id) AS reading_id
  FROM positioning WHERE symbol IS NOT NULL AND ts IS NOT NULL AND open_interest IS NOT NULL GROUP BY 1, 2),
c AS (
  SELECT l.settlement_id, r.reading_id,
         row_number() OVER (PARTITION BY l.settlement_id
                            ORDER BY abs(epoch_us(r.ts) - epoch_us(l.ts)), r.ts, r.reading_id) AS k
  FROM l JOIN r ON l.s = r.s AND r.ts BETWEEN l.ts - INTERVAL 600 SECOND AND l.ts + INTERVAL 600 SECOND)
SELECT settlement_id, reading_id FROM c WHERE k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL}
