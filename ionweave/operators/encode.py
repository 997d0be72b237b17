"""Spectra as binary hypervectors.

A dimension's bit is 1 if, over the peaks, the products of the level's sign and the bin's sign sum to more than zero.
``encode`` does that on packed bits in Arrow batches with the codebook broadcast; ``encode_relational`` does it as joins and a sum
over codebook tables, to check the former and for any table of signs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.config import Settings
from ionweave.functions.peaks import level, mz_bin
from ionweave.operators import codebook as books
from ionweave.schema import ENCODED
from ionweave.session import ship

#: Peaks whose bits are unpacked together.
CHUNK = 4096


def encode_arrays(levels: np.ndarray, bins: np.ndarray, lengths: np.ndarray, book: books.Codebook) -> np.ndarray:
    """Packed bits of spectra whose peaks' levels and bins follow each other; ``lengths`` has the peaks of each."""
    out = np.zeros((len(lengths), book.dim // 8), dtype=np.uint8)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        begin = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + CHUNK, side="right")))
        n = lengths[first:last]
        part = slice(begin, ends[last - 1])
        some = np.flatnonzero(n)
        if some.size:
            apart = np.unpackbits(book.levels[levels[part]] ^ book.bins[bins[part]], axis=1)
            starts = (ends[first:last] - n - begin)[some]
            differ = np.add.reduceat(apart, starts, axis=0, dtype=np.int32)
            out[first:last][some] = np.packbits(2 * differ < n[some][:, None], axis=1)
        first = last
    return out


def encode(clean: DataFrame, s: Settings, book: books.Codebook | None = None) -> DataFrame:
    """ENCODED rows. Bins beyond the codebook can't occur in clean spectra; other input with them is an error."""
    shared = ship(clean.sparkSession).sparkContext.broadcast(book or books.build(s))
    keep = [f for f in ENCODED.names if f != "hv"]
    low, width = s.min_mz or 0.0, s.fragment_tol
    rows = clean.select(*keep, F.transform("peaks", lambda p: level(p["intensity"], s.hd_Q)).alias("l"), F.transform("peaks", lambda p: mz_bin(p["mz"], s.mz_binning, low, width)).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            levels, bins = batch.column("l"), batch.column("b")
            lengths = np.diff(levels.offsets.to_numpy())
            bits = encode_arrays(levels.flatten().to_numpy(), bins.flatten().to_numpy(), lengths, book)
            words = bits.view(">u8").astype("<u8").view("<i8")
            hv = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, words.shape[1], dtype=np.int32)), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), hv], names=[*keep, "hv"])

    return rows.mapInArrow(run, T.StructType([ENCODED[c] for c in [*keep, "hv"]])).select(*ENCODED.names)


def encode_relational(peaks: DataFrame, levels: DataFrame, bins: DataFrame, key: list[str]) -> DataFrame:
    """(key, dim, bit) from exploded peaks (key, level, bin) and sign tables (level, dim, sign) and (bin, dim, sign)."""
    met = peaks.join(levels.withColumnRenamed("sign", "ls"), "level").join(bins.withColumnRenamed("sign", "bs"), ["bin", "dim"])
    return met.groupBy(*key, "dim").agg((F.sum(F.col("ls") * F.col("bs")) > 0).cast("int").alias("bit"))
