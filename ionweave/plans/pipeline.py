"""The whole run: read, clean, encode, cluster, write; with checkpoints between."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ionweave.config import Settings
from ionweave.operators.clean import charges, clean
from ionweave.operators.cluster import cluster
from ionweave.operators.encode import encode
from ionweave.schema import CLUSTERED
from ionweave.session import cut, one_file, ship
from ionweave.sources.checkpoints import load_checkpoint, save_checkpoint
from ionweave.sources.mgf import read_mgf, write_mgf

log = logging.getLogger("ionweave")


class Counts:
    """Counts of the rows that pass some steps of a run. They are taken in the jobs that pass them on, so none is run for them, and a step
    whose rows come from elsewhere (a checkpoint) has none."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}
        self.told: dict[str, dict] = {}

    def of(self, step: str, df: DataFrame, *more: Column) -> DataFrame:
        self.seen[step] = Observation(f"ionweave {step} {uuid.uuid4().hex}")
        return df.observe(self.seen[step], F.count(F.lit(1)).alias("rows"), *more)

    def tell(self, steps: tuple[str, ...] = ()) -> dict[str, dict]:
        """Log what has been counted and not been told; to be called when the jobs are done. ``steps``: only these."""
        for step in [x for x in self.seen if not steps or x in steps]:
            self.told[step] = self.seen.pop(step).get
            log.info("%s: %s", step, ", ".join(f"{k} {v}" for k, v in self.told[step].items()))
        return self.told


def encoded_spectra(spark: SparkSession, s: Settings, counts: Counts | None = None) -> DataFrame:
    """Encoded spectra from the checkpoint, or from the files, which then make the checkpoint."""
    counts = counts or Counts()

    def made(s: Settings) -> DataFrame:
        raw = counts.of("spectra read", read_mgf(spark, s.input_filepath))
        return counts.of("spectra encoded", encode(counts.of("spectra kept by cleaning", clean(raw, s)), s))

    if s.checkpoint:
        found = load_checkpoint(spark, s.checkpoint, s)
        if found is None:
            # the checkpoint holds all charges, so that it serves runs over any of them
            save_checkpoint(made(_all_charges(s)), s.checkpoint, s)
            counts.tell()
            found = load_checkpoint(spark, s.checkpoint, s)
        return charges(found, s.cluster_charges)
    return made(s)


def _all_charges(s: Settings) -> Settings:
    from dataclasses import replace

    return replace(s, cluster_charges=())


def representative_spectra(raw: DataFrame, clustered: DataFrame, compat: bool = False) -> DataFrame:
    """The raw spectra of the representatives, with cluster and title. The join is on (identifier, spec_index), which is
    unique; ``compat`` joins on the five values that the result's columns have."""
    keys = ["precursor_charge", "identifier", "scan", "precursor_mz", "retention_time"] if compat else ["identifier", "spec_index"]
    reps = clustered.filter("is_representative").select(*keys, "cluster")
    return raw.join(reps, keys).withColumn("title", F.concat_ws(":", "identifier", "spec_index", "scan"))


def run(spark: SparkSession, s: Settings) -> DataFrame:
    """Cluster the spectra of a folder; writes ``<output>.parquet``, and ``<output>.mgf`` if asked. Returns the result.

    Both are in order, by charge and bucket: folders of parts that follow each other, or with ``single_files`` a file each."""
    ship(spark)
    log.info("settings: %s", s)
    counts = Counts()
    encoded = encoded_spectra(spark, s, counts)
    done = cluster(encoded, s, stored=bool(s.checkpoint))
    by_charge = [F.count_if(F.col("precursor_charge") == z).alias(f"charge {z}") for z in s.cluster_charges]
    clustered = cut(counts.of("spectra clustered", done, *by_charge, F.count_if("is_representative").alias("representatives")), "clustered")
    counts.tell()
    result = clustered.orderBy("precursor_charge", "bucket", "identifier", "spec_index").select(*CLUSTERED.names)
    target = f"{s.output_filename}.parquet"
    if s.single_files:
        with one_file(spark, target) as folder:
            result.coalesce(1).write.parquet(folder)
    else:
        result.write.mode("overwrite").parquet(target)
    if s.representative_mgf:
        raw = charges(read_mgf(spark, s.input_filepath), s.cluster_charges)
        # labels rise with buckets
        reps = representative_spectra(raw, clustered, s.compat).orderBy("precursor_charge", "cluster")
        write_mgf(reps, f"{s.output_filename}.mgf", single=s.single_files)
    return spark.read.schema(CLUSTERED).parquet(target)


def metrics(clustered: DataFrame) -> DataFrame:
    """By charge: spectra, clusters, clusters of more than one, representatives."""
    sizes = clustered.groupBy("precursor_charge", "cluster").agg(F.count("*").alias("n"), F.count_if("is_representative").alias("reps"))
    return sizes.groupBy("precursor_charge").agg(F.sum("n").alias("spectra"), F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("larger"), F.sum("reps").alias("representatives"))
