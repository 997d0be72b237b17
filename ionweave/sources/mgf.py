"""Reading and writing MGF, the text format of peak lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.session import file_system, one_file, ship

START = "BEGIN IONS"


def _header(body: Column, name: str, number: str) -> Column:
    """The number at the start of a header's value, '' without one."""
    return F.regexp_extract(body, rf"(?m)^{name}=\s*({number})", 1)


def _or(text: Column, kind: str, default) -> Column:
    return F.coalesce(F.when(text != "", text.try_cast(kind)), F.lit(default).cast(kind))


def parse_blocks(blocks: DataFrame, text: str = "value") -> DataFrame:
    """Spectra from texts that each follow a ``BEGIN IONS``; other columns stay.

    Headers may stand anywhere in a block; ``#`` and blank lines are skipped; a peak is a line whose first two words are
    numbers. Blocks without an ``END`` line or without a charge are dropped, as is what follows ``END``. Peaks are sorted by m/z.
    """
    number = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
    kept = blocks.filter(F.col(text).rlike(r"(?m)^END")).withColumn("_body", F.regexp_replace(F.regexp_replace(F.col(text), r"(?ms)^END.*\z", ""), "\r", ""))
    charge = _header(F.col("_body"), "CHARGE", "[0-9]+")
    words = F.transform(F.filter(F.split("_body", "\n"), lambda x: x.rlike(rf"^\s*{number}\s+{number}")), lambda x: F.split(F.trim(x), r"\s+"))
    peaks = F.transform(words, lambda w: F.struct(F.get(w, F.lit(0)).try_cast("float").cast("double").alias("mz"), F.get(w, F.lit(1)).try_cast("float").cast("double").alias("intensity")))
    peaks = F.array_sort(F.filter(peaks, lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull()))
    read = kept.select(
        *[c for c in blocks.columns if c != text],
        charge.alias("_charge"),
        _or(_header(F.col("_body"), "PEPMASS", number), "float", -1).alias("precursor_mz"),
        _or(_header(F.col("_body"), "SCANS", "-?[0-9]+"), "int", -1).alias("scan"),
        _or(_header(F.col("_body"), "RTINSECONDS", number), "float", -1).alias("retention_time"),
        peaks.alias("peaks"),
    )
    return read.filter(F.col("_charge") != "").withColumn("precursor_charge", F.col("_charge").try_cast("byte")).filter("precursor_charge is not null").drop("_charge")


def read_mgf(spark: SparkSession, path: str, pattern: str = "*.mgf") -> DataFrame:
    """The spectra of the MGF files in a folder (or of one file), as RAW.

    Files are split: a record is what stands between two ``BEGIN IONS``. ``spec_index`` orders the spectra of a file: the
    place of the split in units of 1 KiB above, the row in its task in the lower 33 bits; files are under a tebibyte.
    """
    blocks = spark.read.option("lineSep", START).option("pathGlobFilter", pattern).text(path)
    return spectra_of(blocks.select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("file_block_start")))


def spectra_of(blocks: DataFrame) -> DataFrame:
    """RAW spectra of blocks (value, file_name, file_block_start)."""
    place = F.shiftleft(F.shiftright(F.col("file_block_start"), 10), 33)
    rows = blocks.select(
        "value",
        F.regexp_replace("file_name", r"\.[^.]*$", "").alias("identifier"),
        place.bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("spec_index"),
    )
    found = parse_blocks(rows)
    return found.select("identifier", "spec_index", "precursor_charge", "precursor_mz", "scan", "retention_time", "peaks")


def block_text(title, precursor_mz, retention_time, charge, cluster, mz, intensity) -> str:
    """One spectrum as text; numbers are rounded as C's printf does. All its peaks are formatted at once."""
    head = "BEGIN IONS\nTITLE=%s\nPEPMASS=%f\nRTINSECONDS=%f\nCHARGE=%d+\n" % (title, precursor_mz, retention_time, charge)
    if cluster is not None:
        head += f"CLUSTER={cluster:d}\n"
    peaks = np.empty(2 * len(mz))
    peaks[::2], peaks[1::2] = mz, intensity
    return head + "%.5f %.1f\n" * len(mz) % tuple(peaks.tolist()) + "END IONS"


def mgf_blocks(spectra: DataFrame) -> DataFrame:
    """A column ``value`` of block texts. Title and cluster are taken where the columns exist."""
    ship(spectra.sparkSession)
    title = F.col("title") if "title" in spectra.columns else F.concat_ws(":", "identifier", "spec_index", "scan")
    cluster = F.col("cluster").cast("long") if "cluster" in spectra.columns else F.lit(None).cast("long")
    numbers = [F.col("precursor_mz").cast("double").alias("m"), F.col("retention_time").cast("double").alias("r"), F.col("precursor_charge").cast("int").alias("z")]
    peaks = [F.coalesce(F.col(f"peaks.{c}").cast("array<double>"), F.array().cast("array<double>")).alias(c) for c in ("mz", "intensity")]
    rows = spectra.select(title.alias("t"), *numbers, cluster.alias("c"), *peaks)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("mz").offsets.to_numpy()
            mz, intensity = (b.column(c).values.to_numpy(zero_copy_only=False) for c in ("mz", "intensity"))
            heads = zip(*(b.column(c).to_pylist() for c in "tmrzc"), strict=True)
            texts = [block_text(*h, mz[i:j], intensity[i:j]) for h, i, j in zip(heads, at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    return rows.mapInArrow(write, "value string")


def write_mgf(spectra: DataFrame, path: str, files: int | None = None, single: bool = False) -> None:
    """Write spectra as a folder of MGF files, a block a spectrum; ``files`` joins tasks to so many files. With ``single``, ``path`` is
    one file, in the order of the rows."""
    blocks = mgf_blocks(spectra)
    blocks = blocks.coalesce(1 if single else files) if single or files else blocks
    if single:
        with one_file(spectra.sparkSession, path) as folder:
            blocks.write.text(folder)
        return
    blocks.write.mode("overwrite").text(path)
    fs, place = file_system(spectra.sparkSession, path)
    for x in fs.listStatus(place):
        name = x.getPath().getName()
        if name.startswith("part-"):
            fs.rename(x.getPath(), place.suffix(f"/{name.removesuffix('.txt')}.mgf"))
