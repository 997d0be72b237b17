"""Sessions: the package on the executors, the shared folder, and tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the session's executors, once; a job may then run from any folder."""
    context = spark.sparkContext
    if not getattr(context, "_ionweave_shipped", False):
        top = Path(__file__).resolve().parent
        place = Path(tempfile.mkdtemp(prefix="ionweave-")) / "ionweave_modules.zip"
        with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        context.addPyFile(str(place))
        context._ionweave_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is set, a temporary one, but only in local mode: on a cluster,
    a folder of one machine would lose what other machines write."""
    context = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not got:
        jvm_dir = context._jsc.sc().getCheckpointDir()
        got = jvm_dir.get() if jvm_dir.isDefined() else None
    if not got:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        got = tempfile.mkdtemp(prefix="ionweave-")
        context.setCheckpointDir(got)
    return got


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Later stages depend on stored files and not on an executor's memory or shuffle files, so a lost executor costs
    its running tasks only. The files go with ``discard``, at the latest when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ionweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = file_system(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._ionweave_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once all that is made of them is written; other frames are left alone."""
    for t in tables:
        path = getattr(t, "_ionweave_path", None)
        if path:
            files, place = file_system(t.sparkSession, path)
            files.delete(place, True)


@contextmanager
def one_file(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder to write one part to; the part then becomes the file ``path``, in place of what was there."""
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    files, place = file_system(spark, folder)
    _, target = file_system(spark, path)
    try:
        yield folder
        parts = [x.getPath() for x in files.listStatus(place) if x.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise RuntimeError(f"{len(parts)} parts were written for {path}")
        files.delete(target, True)
        files.rename(parts[0], target)
    finally:
        files.delete(place, True)
