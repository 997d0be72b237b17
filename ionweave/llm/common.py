"""What several operators of this subpackage share: reading tables, cutting lineage, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ionweave import session
from ionweave.session import cut, discard, shared_dir

__all__ = ["LOWER", "beside", "cut", "discard", "freed", "fresh", "parts", "resident", "shared_dir", "ship", "spill_freed", "table", "words_of"]

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD_GAPS = "[\\x20\\x09-\\x0D]+"


#: Rows in a batch of texts for Python, where the session has Spark's own number, which is for narrow rows.
BATCH = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Make the session ready for operators on texts: the package on the executors, and batches that hold few texts."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH))
    return session.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text in UTF-8, letters as they are. ``bytes.split`` parts at exactly the six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def spill_freed(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer referred to; the results don't depend on it."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(id_col: str, names: list[str]) -> list[str]:
    """``names`` for columns beside ``id_col``: one that is its name, whatever the case, gets an underscore."""
    return [n + "_" if n.lower() == id_col.lower() else n for n in names]


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


_resident: dict = {}


def resident(key, make: Callable[[], object] = lambda: None):
    """``make()``, kept by the worker until another key is asked for.

    A worker that goes on to another stage needs the memory: what the one before loaded goes, also from the allocators.
    """
    if key not in _resident:
        _resident.clear()
        freed()
        _resident[key] = make()
    return _resident[key]


def freed() -> None:
    """Give memory that is no longer used back to the system; at a task's end, for stages that run in the JVM alone."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, without it
        pass
