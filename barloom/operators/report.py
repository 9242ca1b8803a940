"""The report of a cycle: what the ledger holds, what leads, what speaks against it, what is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTIONS = ("project", "family", "headline", "closed")


def cycle_report(trials: DataFrame, headline: DataFrame, closed: DataFrame) -> DataFrame:
    """(section, subject, symbol, value, text), one row per line of the report.

    headline: (hypothesis_id, symbol, value, reasons), reasons empty where nothing speaks against a cell.
    closed: (hypothesis_id, reason); closed ones are named and leave the headline.
    """
    none = F.lit(None)
    line = lambda d, section, subject, symbol, value, text: d.select(F.lit(section).alias("section"), subject.cast("string").alias("subject"), symbol.cast("string").alias("symbol"), value.cast("double").alias("value"), text.cast("string").alias("text"))
    project = line(trials.agg(F.count(F.lit(1)).alias("n"), F.max("created_utc").alias("z")), "project", F.lit("trials"), none, F.col("n"), F.col("z"))
    family = line(trials.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hypothesis_id").alias("h")), "family", F.col("family"), none, F.col("n"), F.col("h"))
    open_ = headline.join(closed.select("hypothesis_id"), "hypothesis_id", "left_anti")
    why = F.when(F.coalesce(F.col("reasons"), F.lit("")) == "", F.lit("CLEARS EVERY CHECK")).otherwise(F.col("reasons"))
    lead = line(open_, "headline", F.col("hypothesis_id"), F.col("symbol"), F.col("value"), why)
    shut = line(closed, "closed", F.col("hypothesis_id"), none, none, F.col("reason"))
    return project.unionByName(family).unionByName(lead).unionByName(shut)


def render(report: DataFrame, lines: int = 500) -> str:
    """The report as text, at most `lines` rows a section; a longer section says so."""
    out = ["# Cycle report", ""]
    for s in SECTIONS:
        rows = report.where(F.col("section") == s).orderBy(F.desc_nulls_last("value"), "subject", "symbol").limit(lines + 1).collect()
        if not rows:
            continue
        out += [f"## {s.capitalize()}", "", "| subject | symbol | value | |", "|---|---|---:|---|"]
        out += [f"| {r.subject} | {r.symbol or ''} | {'' if r.value is None else format(r.value, 'g')} | {r.text or ''} |" for r in rows[:lines]]
        if len(rows) > lines:
            out.append(f"\nThe first {lines} rows; there are more.")
        if s == "headline" and not any(r.text == "CLEARS EVERY CHECK" for r in rows):
            out.append("\nNo cell clears every check. Nothing in this table is a result.")
        out.append("")
    return "\n".join(out)
