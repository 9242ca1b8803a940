"""Matching records by nearest time.

Right-side stamps become the cells of a one-dimensional nearest-neighbour diagram:
a reading owns the stamps from the midpoint to its predecessor (exclusive) up to the
midpoint to its successor (inclusive, so that ties go to the earlier reading), cut at
the tolerance. Left stamps are then range-joined to the cells through an index of time
buckets: a cell can only reach buckets within the tolerance, and only readings within
twice the tolerance of a bucket can shape the cells in it, so each (entity, bucket) is
independent of all others. A hot entity is thereby spread over as many tasks as it
has buckets; nothing is sorted or collected per entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import canon_symbol, epoch_us


def nearest_match(
    left: DataFrame,
    right: DataFrame,
    *,
    left_key: str,
    right_key: str,
    left_ts: str,
    right_ts: str,
    left_id: str,
    right_id: str,
    tolerance_s: int = 600,
    right_present: str | None = None,
    bucket_tolerances: int = 12,
) -> DataFrame:
    """(left_id, right_id, gap_us): for each distinct (entity, stamp) on the left the nearest right record.

    Entities compare without case and outer blanks. Left rows of one entity and stamp count
    once, under the smallest id; right rows of one entity and stamp likewise. Rows with a null
    entity or stamp, and right rows whose right_present column is null or NaN, do not exist.
    gap_us is right minus left. Unmatched left rows give no row; empty inputs give no rows.
    Columns of either side other than those named are ignored, so clashing names are harmless.
    """
    tol = int(tolerance_s) * 1_000_000
    width = max(1, int(bucket_tolerances)) * max(tol, 1)
    halo = 2 * tol

    r = right
    if right_present is not None:
        r = r.where(F.col(right_present).isNotNull() & ~F.isnan(F.col(right_present).cast("double")))
    r = r.select(canon_symbol(right_key).alias("__e"), epoch_us(right_ts).alias("__t"), F.col(right_id).alias("__rid"))
    r = r.where(F.col("__e").isNotNull() & F.col("__t").isNotNull())
    # A reading shapes its own bucket and those that its halo touches.
    first, last = F.floor((F.col("__t") - halo) / F.lit(width)), F.floor((F.col("__t") + halo) / F.lit(width))
    r = r.withColumn("__b", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    r = r.groupBy("__e", "__b", "__t").agg(F.min("__rid").alias("__rid"))
    w = Window.partitionBy("__e", "__b").orderBy("__t")
    t = F.col("__t")
    # Twice the midpoints, in whole microseconds: no rounding.
    cells = r.select(
        "__e",
        "__b",
        "__rid",
        t.alias("__rt"),
        (F.lag("__t").over(w) + t).alias("__lo2"),
        (F.lead("__t").over(w) + t).alias("__hi2"),
    )

    l = left.select(canon_symbol(left_key).alias("__e"), epoch_us(left_ts).alias("__lt"), F.col(left_id).alias("__lid"))
    l = l.where(F.col("__e").isNotNull() & F.col("__lt").isNotNull())
    l = l.groupBy("__e", "__lt").agg(F.min("__lid").alias("__lid"))
    l = l.withColumn("__b", F.floor(F.col("__lt") / F.lit(width)).cast("bigint"))

    lt = F.col("__lt")
    inside = (
        (F.abs(lt - F.col("__rt")) <= tol)
        & (F.col("__lo2").isNull() | (lt * 2 > F.col("__lo2")))
        & (F.col("__hi2").isNull() | (lt * 2 <= F.col("__hi2")))
    )
    return (
        l.join(cells, ["__e", "__b"])
        .where(inside)
        .select(F.col("__lid").alias(left_id), F.col("__rid").alias(right_id), (F.col("__rt") - lt).alias("gap_us"))
    )
