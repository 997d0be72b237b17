"""Pairs of similar sets by chunks of signatures: a multi-index Hamming join that misses none and needs no pairs of a group.

A set's signature is one-permutation MinHash: a hash deals the elements into bins, and each bin shows 16 bits of its least one. An element
that only one of two sets has can change one bin, so signatures differ in no more bins than the sets differ in elements. Sets of a and b
elements whose similarity is p % or more differ in (100 - p) (a + b) / (100 + p) elements at most: that is the distance threshold. It goes by
sizes, so these fall into bands, each 100 / p as wide as the one before; a set has a signature in its own band and in the next
one, and similar sets have one in common.

The bins of a signature are split into chunks so that, by the pigeonhole principle, any two signatures within the threshold t agree in a chunk but
for the errors it is allowed: chunks times (errors + 1) is more than t. Longer signatures allow none; short ones, of four differing bins at
most, allow one, and each chunk is written once for each bin left out. A chunk is one key of an equi-join.

``connected`` makes components of what keys bring together, without all pairs of a key:

1. The sets of a key are held against that of its smallest document. Links make components.
2. Keys whose documents lie in several components are open. Where at most ``few`` lie outside the largest one, they are held against all
   others of the key, by parity sketches in the condition of a join: what is looked at is ``few`` for each document at most, and only pairs that
   the sketches allow leave it.
3. Documents of other open keys are told apart by the rest of their elements: what they agree in is left out, the rest is binned by another
   hash and split again, as one of these chunks must agree as well, and all steps run on keys of both. After ``depth`` times the rest is held
   against each other as in step 2, whatever its number; nothing is given up.

Keys of one document end at once. A key's smallest document is found by an aggregate that combines before it shuffles; documents meet
it in a join that adaptive execution can split.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.functions.hamming import bits_apart
from ionweave.llm.common import cut, discard, parts, resident, spill_freed
from ionweave.llm.shingles import fetched, mixed
from ionweave.operators.components import components

#: Bins in a chunk for each error it allows, and one more time.
BINS = 8
#: Signatures that differ in this many bins at most allow an error in each chunk.
SHORT = 3
#: Documents outside a key's largest component that are held against all of its documents.
FEW = 1024
#: Bits of the parity sketch that open keys carry.
BITS = 1024
#: Shares of keys that are gathered one after the other.
SHARES = 2
#: Times that open keys are split further.
DEPTH = 3
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_TAG = np.uint64(0xE7037ED1A0B428DB)
#: More than the deepest ``depth``: each has a hash of its own.
DEEPEST = len(_SEEDS)


class Layout:
    """Bands of sizes, and how signatures of a band are split."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]

    def band(self, n: int) -> int:
        while self.lows[-1] <= n:
            # the least size whose similar sets are all in this band or the one before
            self.lows.append(max(self.lows[-1] + 1, (100 * (self.lows[-1] - 1)) // self.percent + 1))
        return bisect_right(self.lows, n) - 1

    def threshold(self, band: int) -> int:
        """Elements that two similar sets differ in at most, if the larger one is of the band."""
        while len(self.lows) <= band + 1:
            self.band(self.lows[-1])
        return 2 * (self.lows[band + 1] - 1) * (100 - self.percent) // (100 + self.percent)

    def split(self, band: int) -> tuple[int, int]:
        """(chunks, errors) of the band's signatures. Sets that may not differ at all are equal and need none."""
        t = self.threshold(band)
        errors = 1 if t <= SHORT else 0
        return (-(-(t + 1) // (errors + 1)) if t else 0), errors

    def keys(self, band: int) -> int:
        chunks, errors = self.split(band)
        return chunks * (2 * BINS if errors else 1)

    def found(self, n: int, place: int) -> tuple[int, int] | None:
        """(band, number within the band) of the key at a place in the keys of a set of n elements."""
        own = self.band(n)
        for band in (own, own + 1):
            if place < self.keys(band):
                return band, place
            place -= self.keys(band)
        return None


def binned(s: np.ndarray, bins: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements by a hash that the bins follow in order, and the bin of each."""
    h = mixed(s ^ _SEEDS[depth % len(_SEEDS)] + np.uint64(depth))
    return h, ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)


def chunk_keys(s: np.ndarray, layout: Layout, band: int, depth: int = 0, upon: int = 0) -> np.ndarray:
    """The keys of a set's signature in a band, ``upon`` the key that they refine."""
    chunks, errors = layout.split(band)
    if not chunks:
        return np.zeros(0, dtype=np.uint64)
    wide = BINS * (errors + 1)
    h, bin_of = binned(s, chunks * wide, depth)
    order = np.argsort(h)
    which, first = np.unique(bin_of[order], return_index=True)
    shown = mixed(h[order][first]) & np.uint64(0xFFFF)
    told = np.zeros(chunks * wide, dtype=np.uint64)
    told[which] = mixed((which.astype(np.uint64) << np.uint64(17)) + shown + np.uint64(1))
    told = told.reshape(chunks, wide)
    whole = told.sum(axis=1, dtype=np.uint64)
    name = mixed(np.array([band * 8 + depth + 1], dtype=np.uint64) * _TAG + np.array([upon], dtype=np.uint64))
    if not errors:
        return mixed(whole + mixed(np.arange(chunks, dtype=np.uint64) + name))
    left_out = (whole[:, None] - told).ravel()
    return mixed(left_out + mixed(np.arange(chunks * wide, dtype=np.uint64) + name))


def remaining(s: np.ndarray, layout: Layout, band: int, places: list[int]) -> np.ndarray:
    """The elements of a set that are in none of the bins of the keys at ``places``, one for each depth."""
    chunks, errors = layout.split(band)
    wide = BINS * (errors + 1)
    left = np.ones(len(s), dtype=bool)
    for depth, place in enumerate(places):
        bins = binned(s, chunks * wide, depth)[1]
        chunk = place // wide if errors else place
        agreed = bins // wide == chunk
        if errors:
            agreed &= bins % wide != place % wide
        left &= ~agreed
    return s[left]


def parity(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bits, a power of two, of which each element turns one over: two sets differ in at least as many elements as these in bits."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.int64)


def wide_parity(s: np.ndarray) -> np.ndarray:
    """Bits as many as elements, for sets of more than ``BITS``, whose short sketch tells little."""
    return parity(s, 1 << (len(s) - 1).bit_length()) if len(s) > BITS else np.zeros(0, dtype=np.int64)


def _sizes(percent: int) -> str:
    """SQL for whether the sizes of two sets, a and b, allow that they are similar."""
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _differ(percent: int) -> str:
    """SQL for the number of elements that similar sets, a and b, differ in at most."""
    return f"floor((na + nb) * {100 - percent} / {100 + percent})"


def near_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, block, n) of the distinct pairs (id, block) whose wide sketches allow that they are similar. Of sketches of two
    lengths the longer one is folded: the parity of two bits is that of the elements that turn either."""
    wide = F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.col("bits"))
    side = lambda p: classes.select(F.col("rep").alias(f"_{p}"), F.col("n").alias(f"n{p}"), wide.alias(f"w{p}"))
    both = pairs.distinct().join(side("a"), F.col("id") == F.col("_a")).join(side("b"), F.col("block") == F.col("_b"))
    both = both.filter(f"{_sizes(percent)} and greatest(size(wa), size(wb)) <= 2 * least(size(wa), size(wb))")
    folded = lambda x, y: F.expr(f"if(size({x}) <= size({y}), {x}, zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q))")
    both = both.select("id", "block", "na", "nb", folded("wa", "wb").alias("bitsa"), folded("wb", "wa").alias("bitsb"))
    near = bits_apart("bitsa", "bitsb") <= F.expr(_differ(percent))
    return both.filter(near).select("id", "block", F.col("na").alias("n")).distinct()


def star_pairs(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, block, n): documents and the smallest one of a key, where they may be similar; written."""
    pairs = met.filter("rep <> leader").select(F.col("rep").alias("id"), F.col("leader").alias("block"))
    return cut(near_enough(pairs, classes, percent), "stars")


def open_rows(met: DataFrame, near: DataFrame) -> DataFrame:
    """(key, rep, n, place, ..., c, big, others, widest): documents, with their components, of keys found in several; written.
    ``big`` is the key's component of most documents, ``others`` the number outside it."""
    known = near.select(F.col("id").alias("_id"), F.col("component").alias("_c"))
    rows = met.drop("leader").join(known, F.col("rep") == F.col("_id"), "left").withColumn("c", F.coalesce("_c", "rep")).drop("_id", "_c")
    rows = cut(rows, "marked")
    by_part = rows.groupBy(F.col("key").alias("_key"), "c").agg(F.count("*").alias("m"), F.max("n").alias("n"))
    spans = by_part.groupBy("_key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("m").alias("all"), F.max("m").alias("most"), F.max_by("c", "m").alias("big"), F.max("n").alias("widest"))
    spans = spans.filter("lo < hi").select("_key", "big", (F.col("all") - F.col("most")).alias("others"), "widest")
    out = cut(rows.join(spans, F.col("key") == F.col("_key")).drop("_key"), "open")
    discard(rows)
    return out


def direct_pairs(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, block, n): pairs of a key from different components that may be similar, each of the few with all others; written."""
    # a column for each word of the sketch: the condition of the join that follows is then compiled
    sketch = [F.get("bits", F.lit(k)).alias(f"w{k}_") for k in range(BITS // 64)]
    of = classes.select(F.col("rep").alias("_r"), F.col("n").alias("_n"), *sketch)
    known = rows.join(of, (F.col("rep") == F.col("_r")) & (F.col("n") == F.col("_n"))).drop("_r", "_n", "path", "others", "widest")
    known = cut(known, "known")
    side = lambda p, df: df.select(*(F.col(x).alias(f"{x}{p}") for x in df.columns))
    a, b = side("a", known.filter("c <> big")), side("b", known)
    # both of the few: once
    once = F.expr("keya = keyb and ca <> cb and (cb = bigb or repa < repb)")
    apart = " + ".join(f"bit_count(w{k}_a ^ w{k}_b)" for k in range(BITS // 64))
    may = F.expr(f"{_sizes(percent)} and {apart} <= {_differ(percent)}")
    pairs = a.join(b, once & may).select(F.col("repb").alias("id"), F.col("repa").alias("block"))
    out = cut(near_enough(pairs, classes, percent), "pairs")
    discard(known)
    return out


def refined(docs: DataFrame, rows: DataFrame, depth: int, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(key, rep, n, path, place): the keys at ``depth`` of documents of open keys, by what these don't agree in; written."""
    wanted = rows.groupBy(F.col("rep").alias("id")).agg(F.collect_set(F.struct("key", "path")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = resident(("chunks", percent), lambda: Layout(percent))
        for b in parts(batches):
            for elements, i, at in zip(*(b.column(c).to_pylist() for c in ("elements", "id", "at")), strict=True):
                s = np.frombuffer(elements, dtype=np.uint64)
                for x in at:
                    found = layout.found(len(s), x["path"][0])
                    if found is None:
                        continue
                    band, first = found
                    left = remaining(s, layout, band, [first, *x["path"][1:]])
                    keys = chunk_keys(left, layout, band, depth, x["key"] & (2**64 - 1))
                    n = len(keys)
                    columns = [pa.array(keys.view(np.int64)), pa.array([i] * n, pa.int64()), pa.array([len(s)] * n, pa.int32()), pa.array([x["path"]] * n, pa.list_(pa.int32())), pa.array(range(n), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "rep", "n", "path", "place"])

    got = fetched(docs, wanted, id_col, text_col, k).select("elements", "id", "at")
    return cut(got.mapInArrow(run, "key long, rep long, n int, path array<int>, place int"), "refined")


def both_bands(s: np.ndarray, layout: Layout) -> np.ndarray:
    """The keys of a set in its band and the next one."""
    own = layout.band(len(s))
    return np.concatenate([chunk_keys(s, layout, own), chunk_keys(s, layout, own + 1)])


def connected(
    docs: DataFrame,
    classes: DataFrame,
    keyed: DataFrame,
    near: DataFrame | None,
    confirm: Callable[[DataFrame], DataFrame],
    id_col: str,
    text_col: str,
    k: int,
    percent: int,
    few: int = FEW,
    depth: int = DEPTH,
) -> DataFrame:
    """(id, component) of what was known (``near``) and what similar documents of common keys connect; written.

    ``keyed`` (rep, n, keys) is deleted once read; ``classes`` (rep, n, bits, wide) has the sketches of all documents; ``confirm`` makes
    links (a, b), written, of pairs (id, block, n) that may be similar.
    """
    how = {"id_col": id_col, "text_col": text_col, "k": k, "percent": percent}
    keys = keyed.select("rep", "n", F.posexplode("keys").alias("place", "key"))
    for step in range(depth + 1):
        found = []
        # a share of the keys at a time, so that not all of them lie in shuffle files at once
        for share in range(SHARES):
            own = keys.filter(F.pmod("key", F.lit(SHARES)) == share)
            heads = own.groupBy(F.col("key").alias("_key")).agg(F.min("rep").alias("leader"), F.max("rep").alias("_last")).filter("leader < _last").drop("_last")
            heads = cut(heads, "heads")
            spill_freed(docs.sparkSession)
            path = F.concat("path", F.array("place")) if step else F.array("place")
            met = own.join(heads, F.col("key") == F.col("_key")).select("key", "rep", "n", path.alias("path"), "leader")
            found.append(cut(met, "met"))
            discard(heads)
            spill_freed(docs.sparkSession)
        discard(keyed)
        met = reduce(DataFrame.unionByName, found)
        stars = star_pairs(met, classes, percent)
        near = grown(near, confirm(stars))
        discard(stars)
        rest = open_rows(met, near)
        discard(*found)
        # as many rows for each document as a further split would write, or a few
        enough = F.col("others") <= F.greatest(F.lit(few), F.col("widest") * 2 * (100 - percent) / (100 + percent))
        direct = rest if step == depth else rest.filter(enough)
        pairs = direct_pairs(direct, classes, percent)
        if not pairs.isEmpty():
            near = grown(near, confirm(pairs))
        discard(pairs)
        left = rest.filter(~enough)
        if step == depth or left.isEmpty():
            discard(rest)
            break
        keys = keyed = refined(docs, left, step + 1, **how)
        discard(rest)
    return near


def grown(near: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) of what was known and new links; written, the tables it is made of deleted."""
    edges = links if near is None else near.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)
    out = cut(found := components(edges), "near")
    discard(found, links, *([near] if near is not None else []))
    return out
