"""Pairs of spectra of a bucket whose precursors agree, and the blocks beyond which none do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.functions.hamming import distance
from ionweave.operators.tiles import spread


def agree(a: Column, b: Column, tolerance: float, unit: str) -> Column:
    """Whether two precursors are closer than the tolerance; in ppm, of the second."""
    d = F.abs(a - b)
    return d < float(tolerance) if unit == "Da" else d * 1e6 < F.abs(b) * float(tolerance)


def precursor_blocks(df: DataFrame, tolerance: float, unit: str, keys: tuple[str, ...] = ("precursor_charge", "bucket")) -> DataFrame:
    """``df`` with a column ``block``: a bucket is cut where neighbours by precursor m/z are farther apart than the tolerance.

    Pairs across a cut have the largest distance there is, so no cluster at a threshold below that crosses one.
    """
    w = Window.partitionBy(*keys).orderBy("precursor_mz")
    m = F.col("precursor_mz").cast("double")
    gap = m - F.lag(m).over(w)
    cut = gap >= float(tolerance) if unit == "Da" else gap * 1e6 >= m * float(tolerance)
    marked = df.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    return marked.withColumn("block", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_cut")


#: Rows of a run, whose pairs with another are made together.
RUN = 256
#: Runs whose pairs with all of their group go to one task.
SHARE = 16


def pairs(df: DataFrame, id_col: str, tolerance: float | None, unit: str = "ppm", keys: tuple[str, ...] = ("precursor_charge", "bucket"), hv: str = "hv", words: int | None = None) -> DataFrame:
    """(keys, i, j, dist) for i < j in a group with agreeing precursors (None: all). Pairs that aren't there are 1.0 apart. ``words``: the
    length of all vectors, where it is known, for a compiled distance.

    A group is cut into runs, by precursor and id, which meet in an equi-join on the group; runs that have no pair are told by their ends. The
    pairs of two runs follow each other, so that each i has the same j as the one before: files of pairs then take a fraction of the
    bytes. A task has the pairs of ``SHARE`` runs with the group, so a large group is spread over tasks.
    """
    keys = list(keys)
    mz = F.col("precursor_mz").cast("double")
    # what agrees with nothing is in no pair
    rows = df if tolerance is None else df.filter(F.abs(mz) < float("inf"))
    row = [F.col(id_col).alias("id"), F.col(hv).alias("hv"), *([] if tolerance is None else [mz.alias("mz")])]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*([] if tolerance is None else [mz]), id_col))
    rows = rows.select(*keys, F.struct(*row).alias("row"), F.floor((nth - 1) / RUN).cast("int").alias("run"))
    ends = [f(F.col(f"row.{c.removeprefix('_')}")).alias(f"{n}{c}") for c in (["_id"] if tolerance is None else ["_id", "_mz"]) for n, f in (("least", F.min), ("most", F.max))]
    runs = rows.groupBy(*keys, "run").agg(F.sort_array(F.collect_list("row")).alias("rows"), *ends)
    shares = runs.groupBy(*keys).agg(F.max(F.floor(F.col("run") / SHARE)).cast("int").alias("_shares"))
    left = runs.withColumn("_share", F.floor(F.col("run") / SHARE).cast("int")).alias("a")
    right = runs.join(shares, keys).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares")))).drop("_shares").alias("b")
    left, right = (spread(x, *keys, "_share") for x in (left, right))
    on = F.col("a.least_id") < F.col("b.most_id")
    for k in [*keys, "_share"]:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    if tolerance is not None:
        gap = F.greatest(F.col("b.least_mz") - F.col("a.most_mz"), F.col("a.least_mz") - F.col("b.most_mz"), F.lit(0.0))
        width = F.lit(float(tolerance)) if unit == "Da" else F.greatest(F.abs("b.least_mz"), F.abs("b.most_mz")) * float(tolerance) / 1e6
        # with some room for rounding; rows are asked themselves
        on = on & (gap <= width * (1 + 1e-6))
    met = left.join(right, on).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.explode("a.rows").alias("a"), F.col("b.rows").alias("_with")).select(*keys, "a", F.explode("_with").alias("b"))
    own = F.col("a.id") < F.col("b.id")
    if tolerance is not None:
        own = own & agree(F.col("a.mz"), F.col("b.mz"), tolerance, unit)
    return met.filter(own).select(*keys, F.col("a.id").alias("i"), F.col("b.id").alias("j"), distance(F.col("a.hv"), F.col("b.hv"), words).alias("dist"))
