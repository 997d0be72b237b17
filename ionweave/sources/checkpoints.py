"""Encoded spectra on disk, laid out for clustering, with the settings that made them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from ionweave.config import Settings
from ionweave.schema import ENCODED

#: What files are bucketed by, and what they are sorted by within a bucket.
BUCKETED = ("precursor_charge", "bucket")
SORTED = ("precursor_charge", "bucket", "precursor_mz")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _table(path: str) -> str:
    return "ionweave_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def save_checkpoint(encoded: DataFrame, path: str, settings: Settings, buckets: int | None = None) -> None:
    """Write ``encoded`` in as many buckets of charge and mass bucket as there are shuffle partitions, so that a run that goes on from
    here finds the rows of a group together and shuffles no vectors."""
    spark = encoded.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = encoded.select(*ENCODED.names).repartition(n, *BUCKETED)
    name = _table(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = rows.write.mode("overwrite").format("parquet").option("path", f"{path}/spectra")
    writer.bucketBy(n, *BUCKETED).sortBy(*SORTED).saveAsTable(name)
    told = json.dumps({"settings": settings.signature(), "buckets": n}, sort_keys=True)
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_checkpoint(spark: SparkSession, path: str, settings: Settings) -> DataFrame | None:
    """The checkpoint's spectra, None if there is none. Other settings than those it was made with are refused. Another session
    than the one that wrote it learns of its buckets from the settings."""
    if not _exists(spark, f"{path}/spectra/_SUCCESS") or not _exists(spark, f"{path}/settings/_SUCCESS"):
        return None
    told = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/settings").take(10)))
    made, n = (told["settings"], told["buckets"]) if "settings" in told else (told, None)
    now = json.loads(json.dumps(settings.signature()))
    if made != now:
        raise ValueError(f"checkpoint {path} was made with other settings: " + ", ".join(k for k in now if made.get(k) != now[k]))
    if n is None:
        return spark.read.schema(ENCODED).parquet(f"{path}/spectra")
    name = _table(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENCODED.fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(BUCKETED)}) SORTED BY ({', '.join(SORTED)}) INTO {n} BUCKETS LOCATION '{path}/spectra'"
    )
    return spark.table(name)
