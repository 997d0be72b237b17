"""The driver's tables as spectra and as signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A peak for each line item, with its part's precursor."""
    mz = 50 + ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 150000) / F.lit(100.0)
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", mz.alias("mz"), F.col("l_extendedprice").alias("intensity"))
    parts = _parts(spark, sf_dir)
    return lines.join(parts, lines.l_partkey == parts.id).drop("l_partkey")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        (F.col("p_size") % 2 + 2).cast("byte").alias("precursor_charge"),
        F.col("p_retailprice").cast("float").alias("precursor_mz"),
        (F.col("p_size") * 60).cast("float").alias("retention_time"),
    )


def precursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spectra`` without their peaks: of line items only the parts' keys are read, and each once from a task."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    rows = _parts(spark, sf_dir).distinct().join(lines, F.col("id") == F.col("l_partkey"), "left_semi")
    return rows.select(F.col("id").cast("long").alias("spec_index"), "precursor_charge", "precursor_mz", "retention_time")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW spectra, one for each part that has line items; their order is by part."""
    keys = ["id", "precursor_charge", "precursor_mz", "retention_time"]
    rows = part_peaks(spark, sf_dir).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    return rows.select(F.lit("parts").alias("identifier"), F.col("id").cast("long").alias("spec_index"), "precursor_charge", "precursor_mz", F.col("id").cast("int").alias("scan"), "retention_time", "peaks")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, bucket, hv): a vector's signs as one 64-bit word, its label as the bucket."""
    word = F.expr("aggregate(transform(embedding, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("bucket"), F.array(word).alias("hv"))
