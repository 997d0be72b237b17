"""Shingle sets of texts as sorted 64-bit hashes, and what joins on them share: bitmaps of wanted documents, places in blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.llm.common import LOWER, freed, parts, resident, ship

#: Documents in one block of an index, and a sixteenth of the queries that a task puts to it.
BLOCK = 256
#: Elements in one block of an index, where documents are long: 8 MB.
ELEMENTS = 1 << 20
#: Bits of the bitmap of wanted documents.
MARKS = 1 << 25
SLICE = 100_000
_rng = np.random.RandomState(20240131)
_odd = lambda n: _rng.randint(0, 2**32, n).astype(np.uint64) << np.uint64(32) | _rng.randint(0, 2**32, n).astype(np.uint64) | np.uint64(1)
_BYTE, _PLACE, _SHORT, _SALT = _odd(256), _odd(64), _odd(64), _odd(4)
_BASE = int(_odd(1)[0])
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_NEXT_GAP = re.compile(rb"[\x09-\x0d\x20]")
#: Powers of the base and of its inverse, for texts of usual length.
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least of each. Only those for slices are kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(max(n, 2 * SLICE), base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n <= 2 * SLICE:
        _powers[:] = out
    return out


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in some text, and a hash of each."""
    raw = np.frombuffer(raw, dtype=np.uint8)
    gap = _GAP[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = powers(len(raw) + 1)
    sums = np.cumsum(np.where(gap, np.uint64(0), _BYTE[raw]) * power[: len(raw)])
    sums = np.concatenate([np.zeros(1, np.uint64), sums])
    return starts, mixed((sums[ends] - sums[starts]) * inverse[starts])


def long_words(raw: bytes) -> np.ndarray:
    """The hashes of the words of a long text, which is read in slices that end between words."""
    out, at = [], 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            found = _NEXT_GAP.search(raw, end)
            end = found.start() if found else len(raw)
        out.append(hashed_words(raw[at:end])[1])
        at = end
    return np.concatenate(out)


def windows_of(word: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words that follow each other."""
    n = max(len(word) - k + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += word[j : j + n] * _PLACE[j]
    return mixed(out)


def short_text(word: np.ndarray) -> np.ndarray:
    """The one element of a text of fewer than k words, if it has any."""
    if not len(word):
        return np.zeros(0, dtype=np.uint64)
    return mixed(np.array([(word * _SHORT[: len(word)]).sum(dtype=np.uint64) + np.uint64(len(word))], dtype=np.uint64))


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Short texts are hashed in slices together, a long one in slices
    of its own, so memory goes with the words of one text."""
    at = 0
    while at < len(texts):
        some, total = [], 0
        while at < len(texts) and (not some or total + len(some[-1]) <= SLICE):
            some.append((texts[at] or "").encode("utf-8").translate(LOWER))
            total += len(some[-1]) + 1
            at += 1
        if len(some) == 1 and some[0]:
            word = long_words(some[0])
            first = np.array([0, len(word)])
        else:
            starts, word = hashed_words(b" ".join(some))
            first = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(x) + 1 for x in some])]))
        windows = windows_of(word, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(windows[a : b - k + 1]) if b - a >= k else short_text(word[a:b])


def hash_ids(ids):
    """A hash of ids that needs only what Spark's columns and numpy do alike: ids that follow each other spread, shifts mix."""
    if isinstance(ids, np.ndarray):
        return ids ^ (ids >> 25) ^ (ids >> 50)
    return ids.bitwiseXOR(F.shiftright(ids, 25)).bitwiseXOR(F.shiftright(ids, 50))


def marked_ids(places: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (4 MB) in which the hash of each id sets a bit. Documents whose bit isn't set need not be shuffled;
    the more ids, the fewer it spares, and no result depends on it."""
    place = hash_ids(F.col("id")).bitwiseAND(F.lit(MARKS - 1))
    got = places.select(F.shiftright(place, 6).alias("word"), place.alias("p")).select("word", F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    got = got.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(MARKS // 64, dtype=np.int64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    return words


def named_by(ids: pa.Array, words: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the bit of each id; a null id has none."""
    h = hash_ids(ids.fill_null(0).to_numpy(zero_copy_only=False)) & np.int64(MARKS - 1)
    return (((words[h >> 6] >> (h & 63)) & 1) == 1) & ids.is_valid().to_numpy(zero_copy_only=False)


def placed(members: DataFrame, queries: DataFrame, block_size: int) -> DataFrame:
    """Places (id, block, salt, asks) of members (id, block, n) and queries (id, block): members are dealt into salts of
    bounded size, queries into as many chunks as bound theirs, and each salt meets each chunk once."""
    count = lambda x: F.ceil(x).cast("long")
    salts = F.greatest(F.count("*") / F.lit(float(block_size)), F.sum("n") / F.lit(float(ELEMENTS)))
    sizes = members.groupBy("block").agg(count(salts).alias("salts")).withColumnRenamed("block", "_b")
    asked = queries.groupBy("block").agg(count(F.count("*") / F.lit(float(16 * block_size))).alias("chunks"))
    sizes = sizes.join(asked, F.col("_b") == F.col("block")).select("_b", "salts", "chunks")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n))

    def dealt(rows: DataFrame, salt, chunk, asks: int) -> DataFrame:
        met = rows.join(sizes, F.col("block") == F.col("_b")).select("id", "block", "chunks", "salts", salt.alias("s"))
        met = met.select("id", "block", "chunks", "s", chunk.alias("c"))
        return met.select("id", "block", (F.col("s") * F.col("chunks") + F.col("c")).alias("salt"), F.lit(asks).alias("asks"))

    return dealt(members, deal("salts"), all_of("chunks"), 0).unionByName(dealt(queries, all_of("salts"), deal("chunks"), 1))


def fetched(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``wanted`` (id, ...), a row for each document, with its set as ``elements``. Others are passed over by a bitmap, then by the join."""
    named = ship(docs.sparkSession).sparkContext.broadcast(marked_ids(wanted.select("id")))

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("shingles")
        for b in parts(batches):
            b = b.filter(pa.array(named_by(b.column(0), named.value)))
            sets = pa.array([s.tobytes() for s in shingle_sets(b.column(1).to_pylist(), k)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["_id", "elements"])
        freed()

    sets = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(hash_sets, "_id long, elements binary")
    return sets.join(wanted, F.col("_id") == F.col("id")).drop("_id")
