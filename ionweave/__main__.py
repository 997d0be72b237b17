"""Command line: ``python -m ionweave INPUT_FOLDER OUTPUT_STEM [options]``."""

from __future__ import annotations

import logging
import os
from pathlib import Path

from pyspark.sql import SparkSession

from ionweave.config import from_args
from ionweave.plans.pipeline import metrics, run


def main(args: list[str] | None = None) -> int:
    settings = from_args(args)
    log_to = [logging.StreamHandler()]
    if Path(settings.output_filename).parent.is_dir():
        log_to.append(logging.FileHandler(f"{settings.output_filename}.log"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s", handlers=log_to)
    builder = SparkSession.builder.appName("ionweave").config("spark.sql.adaptive.enabled", "true")
    if "SPARK_MASTER" not in os.environ and "MASTER" not in os.environ and "PYSPARK_GATEWAY_PORT" not in os.environ:
        # not started by spark-submit, which names a master
        builder = builder.master(f"local[{max(settings.cpu_core_preprocess, settings.cpu_core_cluster)}]")
    spark = builder.getOrCreate()
    metrics(run(spark, settings)).orderBy("precursor_charge").show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
