"""New MGF files of a folder, encoded as they arrive: Structured Streaming over the same operators as a batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ionweave.config import Settings
from ionweave.operators.clean import clean
from ionweave.operators.encode import encode
from ionweave.session import ship
from ionweave.sources.mgf import START, spectra_of


def encode_stream(spark: SparkSession, s: Settings, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the encoded spectra of new files to ``output``; with ``once``, those there are now, else until it is stopped.

    A batch that is run again after a failure overwrites its own folder, so its rows are there once. State is the list of files seen only.
    """
    ship(spark)
    blocks = spark.readStream.option("lineSep", START).option("pathGlobFilter", "*.mgf").text(s.input_filepath)
    named = blocks.select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("file_block_start"))

    def write(batch: DataFrame, number: int) -> None:
        encode(clean(spectra_of(batch), s), s).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
