"""Running totals over ordered groups without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of one coarse range, as a power of two.
RANGE = 10


def totals_before(groups: DataFrame, value: str, name: str, inner: tuple[str, ...] = ()) -> DataFrame:
    """``groups`` (one row each for charge, bucket and ``inner``) with the sum of ``value`` over the groups of the charge that come
    before, by bucket and ``inner``.

    Three windows, none wider than a range: over ranges of buckets in a charge, over buckets in a range, over groups in a
    bucket. So no task sorts all groups of a charge.
    """

    def before(column: str, keys: list[str], *order: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(w), F.lit(0))

    buckets = groups.groupBy("precursor_charge", "bucket").agg(F.sum(value).alias("_all"))
    buckets = buckets.withColumn("_range", F.shiftright(F.col("bucket").cast("long"), RANGE))
    ranges = buckets.groupBy("precursor_charge", "_range").agg(F.sum("_all").alias("_sum"))
    ranges = ranges.select("precursor_charge", "_range", before("_sum", ["precursor_charge"], "_range").alias("_far"))
    within = buckets.select("precursor_charge", "bucket", "_range", before("_all", ["precursor_charge", "_range"], "bucket").alias("_near"))
    bases = within.join(ranges, ["precursor_charge", "_range"]).select("precursor_charge", "bucket", (F.col("_far") + F.col("_near")).alias("_base"))
    here = before(value, ["precursor_charge", "bucket"], *inner) if inner else F.lit(0)
    out = groups.withColumn("_here", here).join(bases, ["precursor_charge", "bucket"])
    return out.withColumn(name, (F.col("_base") + F.col("_here")).cast("long")).drop("_base", "_here")
