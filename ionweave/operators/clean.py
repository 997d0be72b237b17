"""From raw to clean spectra: one projection over each row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.config import Settings
from ionweave.functions import peaks as P
from ionweave.operators.prefix import totals_before


def cleaned_peaks(s: Settings, peaks="peaks", precursor_mz="precursor_mz", charge="precursor_charge") -> Column:
    """The clean peaks of a spectrum, null where too few or too narrow a range remain after any step."""
    none = F.lit(None).cast(P.PEAKS)

    def checked(p: Column, then) -> Column:
        return P.let(p, lambda x: F.when(P.is_valid(x, s.min_peaks, s.min_mz_range), then(x)).otherwise(none))

    def last(p: Column) -> Column:
        return P.unit_norm(P.scale(p, s.scaling, s.max_peaks_used))

    def strongest(p: Column) -> Column:
        return checked(P.most_intense(p, s.max_peaks_used, s.min_intensity), last)

    def without_precursor(p: Column) -> Column:
        if s.remove_precursor_tol is None:
            return strongest(p)
        return checked(P.remove_precursor(p, precursor_mz, charge, s.remove_precursor_tol), strongest)

    return checked(P.mz_range(peaks, s.min_mz, s.max_mz), without_precursor)


def charges(df: DataFrame, wanted: tuple[int, ...]) -> DataFrame:
    """The rows of the wanted charges; all of them if none is named."""
    return df.filter(F.col("precursor_charge").isin(*wanted)) if wanted else df


def clean(raw: DataFrame, s: Settings) -> DataFrame:
    """Clean spectra with their buckets. The charge filter comes first, so it reaches a parquet scan; the generator keeps
    the optimiser from working the peaks out once for each test of them."""
    kept = charges(raw, s.cluster_charges)
    rest = [c for c in raw.columns if c != "peaks"]
    rows = kept.select(*rest, F.explode(F.filter(F.array(cleaned_peaks(s)), lambda p: p.isNotNull())).alias("peaks"))
    return rows.withColumn("bucket", P.bucket("precursor_mz", "precursor_charge", s.mz_interval))


def bucket_sizes(df: DataFrame) -> DataFrame:
    """Spectra of each bucket."""
    return df.groupBy("precursor_charge", "bucket").agg(F.count("*").alias("size"))


def bucket_ranges(df: DataFrame) -> DataFrame:
    """Spectra of each bucket, and the first and last place they take where those of a charge are in order."""
    placed = totals_before(bucket_sizes(df), "size", "first")
    return placed.withColumn("last", F.col("first") + F.col("size") - 1)


def size_histogram(df: DataFrame, edges: tuple[int, ...] = (0, 300, 1000, 5000, 10000, 20000, 30000)) -> DataFrame:
    """(bin, buckets, share): buckets by size in half-open bins, the last closed; share in percent of all buckets."""
    size = F.col("size")
    bin_ = F.when((size == edges[-1]), F.lit(len(edges) - 2))
    for k in range(len(edges) - 1):
        bin_ = bin_.when((size >= edges[k]) & (size < edges[k + 1]), F.lit(k))
    counted = bucket_sizes(df).select(bin_.alias("bin")).groupBy("bin").agg(F.count("*").alias("buckets"))
    # at most one row for each bin goes through the window
    share = 100.0 * F.col("buckets") / F.sum("buckets").over(Window.partitionBy(F.lit(0)))
    return counted.withColumn("share", share).filter("bin is not null").select("bin", "buckets", "share")
