"""What disqualifies a result, and how close a search is to its target. Unmeasured is never a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.operators.surface import target_met


def disqualifiers(best: Column, floor: Column, shape: Column, paths: Column, pbo: Column, pbo_covers_best: Column, p_value: Column, survives: Column) -> Column:
    """Reasons in a fixed order; an empty list is a survivor."""
    num = lambda c, d: F.format_number(c, d)
    covered = F.coalesce(pbo_covers_best, F.lit(False)) & pbo.isNotNull()
    reasons = [
        F.when(best.isNull() | (best <= floor), F.concat(F.lit("at or below "), floor.cast("string"))),
        F.when(shape.isNull() | (shape == "NONE") | (shape == "UNMEASURABLE"), F.lit("shape unmeasured")).when(shape == "SPIKE", F.lit("spike")),
        F.when(paths.isNull(), F.lit("path count unmeasured")).when(paths < K.FEW_PATHS, F.concat(num(paths, 2), F.lit(" paths"))),
        F.when(~covered, F.lit("PBO unmeasured")).when(pbo >= K.PBO_USELESS, F.concat(F.lit("PBO "), num(pbo, 2))),
        F.when(p_value.isNull(), F.lit("search test unmeasured")).when(~F.coalesce(survives, F.lit(False)), F.concat(F.lit("p="), num(p_value, 3), F.lit(" vs a random search"))),
    ]
    return F.array_compact(F.array(*reasons))


def candidates(rows: DataFrame, *, hypothesis: str, signature: str, symbol: str, cagr: str, drawdown: str) -> DataFrame:
    """(hypothesis, signature, symbols, n_symbols, worst_cagr, best_cagr): cells that meet the target, by parameters without symbol.

    Different parameters on different symbols are different results, so they are never counted together.
    """
    ok = rows.where(target_met(F.col(cagr), F.col(drawdown)))
    return ok.groupBy(hypothesis, signature).agg(
        F.array_sort(F.collect_set(symbol)).alias("symbols"), F.count_distinct(symbol).alias("n_symbols"), F.min(cagr).alias("worst_cagr"), F.max(cagr).alias("best_cagr")
    )


CHECKS = ("symbols", "not_disqualified", "robustness", "execution", "holdout")


def checked_state(c: DataFrame, *, disqualified: str, robust: str, executed: str, holdout: str) -> DataFrame:
    """c with failed, unmeasured and state; each check is true, false or null where any symbol lacks the measurement."""
    checks = dict(zip(CHECKS, [F.col("n_symbols") >= K.TARGET_SYMBOLS, ~F.col(disqualified), F.col(robust), F.col(executed), F.col(holdout)]))
    named = lambda when: F.array_join(F.array_compact(F.array(*[F.when(when(x), F.lit(n)) for n, x in sorted(checks.items())])), ",")
    d = c.withColumns({"failed": named(lambda x: F.coalesce(~x, F.lit(False))), "unmeasured": named(lambda x: x.isNull())})
    clean, left = F.col("failed") == "", F.col("unmeasured")
    state = F.when(clean & (left == ""), "COMPLETE").when(clean & (left == "holdout"), "VERIFIED_ON_DEVELOPMENT").otherwise("CANDIDATE_UNVERIFIED")
    return d.withColumn("state", state)


def overall_state(candidates: DataFrame) -> DataFrame:
    """(state, candidates): the furthest that any candidate has come; NO_CANDIDATE without one."""
    rank = F.when(F.col("state") == "COMPLETE", 3).when(F.col("state") == "VERIFIED_ON_DEVELOPMENT", 2).otherwise(1)
    best = candidates.agg(F.coalesce(F.max(rank), F.lit(0)).alias("r"), F.count(F.lit(1)).alias("candidates"))
    return best.select(F.element_at(F.array(*[F.lit(x) for x in ("NO_CANDIDATE", "CANDIDATE_UNVERIFIED", "VERIFIED_ON_DEVELOPMENT", "COMPLETE")]), F.col("r") + 1).alias("state"), "candidates")


def best_within(rows: DataFrame, *, value: str, limit_on: str, limit: float, order: Sequence[str]) -> DataFrame:
    """Two rows: the best value, and the best value among those within the limit; the first of ties in `order`."""
    fin = rows.where(F.col(value).isNotNull() & F.col(limit_on).isNotNull() & ~F.isnan(value) & ~F.isnan(limit_on))
    parts = []
    for name, d in (("best", fin), ("best_within_limit", fin.where(F.col(limit_on) <= limit))):
        parts.append(d.orderBy(F.desc(value), *order).limit(1).withColumn("which", F.lit(name)))
    return parts[0].unionByName(parts[1])


def vote_tally(votes: DataFrame, *, subject: str, voter: str, vote: str) -> DataFrame:
    """(subject, voters, outcome): CLOSE or CONTINUE if all agree, else SPLIT; voters who contradict themselves are left out."""
    per = votes.groupBy(subject, voter).agg(F.count_distinct(vote).alias("__n"), F.max(vote).alias("__v")).where(F.col("__n") == 1)
    a = per.groupBy(subject).agg(F.count(F.lit(1)).alias("voters"), F.count_distinct("__v").alias("__k"), F.max("__v").alias("__one"))
    return a.select(subject, "voters", F.when(F.col("__k") == 1, F.col("__one")).otherwise("SPLIT").alias("outcome"))
