"""Near copies by a multi-index Hamming join of MinHash signatures, and the groups that confirmed links make.

A document is the set of its three-word shingles. Its signature is one-permutation MinHash: a hash deals the shingles into bins, and
each bin shows 16 bits of its least shingle. A shingle that only one of two documents has can change one bin, so signatures differ in no more
bins than the sets differ in elements. Sets of a and b elements with a similarity of 85 % or more differ in 15 (a + b) / 185 elements at most: that
is the distance threshold, and it misses no pair. It goes by sizes, so these fall into bands, each 1/0.85 as wide as the one before; a
document has a signature in its own band and in the next one, and similar documents have one in common.

Signatures are split into chunks by the pigeonhole principle, with errors allowed in the chunks of short ones, and documents that have a chunk in common
are brought together without all pairs of a chunk (``chunks`` has both). Equal sets form classes first, of which only the document with the
smallest id goes on. Links are confirmed on full sets and make the groups.

Edge cases: a document of fewer than three words is one shingle of them all. A null or empty text, or one of white space, has no shingles and
links with nothing. Rows that share an id are one vertex; rows without an id have no component and are kept. Very long texts are hashed
whole, in slices. Other columns are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.chunks import DEEPEST, DEPTH, FEW, Layout, both_bands, connected, parity, wide_parity
from ionweave.llm.common import beside, cut, discard, freed, parts, resident, ship, spill_freed, table
from ionweave.llm.shingles import BLOCK, fetched, mixed, placed, shingle_sets

_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB)]


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, n, f1, f2, keys, bits, wide): set size, two hashes of the whole set, its keys, and the parity sketches."""
    schema = "id long, n int, f1 long, f2 long, keys array<long>, bits array<long>, wide array<long>"
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = resident(("chunks", percent), lambda: Layout(percent))
        for b in parts(batches):
            rows = []
            for s in shingle_sets(b.column(1).to_pylist(), k):
                f1 = int(mixed(s * _SALTS[0]).sum(dtype=np.uint64).view(np.int64)) if s.size else 0
                f2 = int(np.bitwise_xor.reduce(mixed(s + _SALTS[1])).view(np.int64)) if s.size else 0
                keys = both_bands(s, layout) if s.size else np.zeros(0, dtype=np.uint64)
                rows.append((len(s), f1, f2, keys.view(np.int64), parity(s), wide_parity(s)))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "n", "f1", "f2", "keys", "bits", "wide"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, schema)


def confirmed(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs (id, block, n) that are similar, as links (a, b); written. The document of a block comes before the others."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("nearcopies-compare")
        block, heads = None, []
        for b in parts(batches):
            out: list[tuple[int, int]] = []
            for q, salt, asks, i, elements in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if (q, salt) != block:
                    block, heads = (q, salt), []
                s = np.frombuffer(elements, dtype=np.uint64)
                if asks:
                    heads.append(s)
                elif any(similar(s, x, percent) for x in heads):
                    out.append((i, q))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])
        block, heads = None, []
        freed()

    heads = pairs.select(F.col("block").alias("id"), "block").distinct()
    places = cut(placed(pairs, heads, BLOCK), "places")
    at = places.groupBy("id").agg(F.collect_list(F.struct("block", "salt", "asks")).alias("at"))
    rows = fetched(docs, at, id_col, text_col, k).select(F.explode("at").alias("x"), "id", "elements").select("x.block", "x.salt", "x.asks", "id", "elements")
    dealt = rows.repartition("block", "salt").sortWithinPartitions("block", "salt", F.desc("asks"))
    links = cut(dealt.mapInArrow(compare, "a long, b long"), "links")
    discard(places)
    spill_freed(docs.sparkSession)
    return links


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85, few: int = FEW, depth: int = DEPTH
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row. ``percent`` is the least similarity, ``k`` the words of a shingle (64 at most)."""
    spark = ship(docs.sparkSession)
    if not 0 < percent <= 100 or not 0 < k <= 64 or not 0 <= depth < DEEPEST:
        raise ValueError(f"percent is 1 to 100, k is 1 to 64, depth is 0 to {DEEPEST - 1}")
    how = {"id_col": id_col, "text_col": text_col, "k": k, "percent": percent}
    signed = cut(signatures(docs, id_col, text_col, k, percent), "signatures")
    classes = signed.filter("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "keys", "bits", "wide")).alias("x"))
    keyed = cut(classes.select("f1", "f2", "n", F.col("x.id").alias("rep"), "x.keys", "x.bits", "x.wide"), "classes")
    own = cut(signed.select("id", "f1", "f2", "n"), "own")
    discard(signed)
    spill_freed(spark)
    classes = cut(keyed.drop("keys"), "classes")

    near = connected(docs, classes, keyed, None, lambda pairs: confirmed(docs, pairs, **how), few=few, depth=depth, **how)
    named = classes.select("f1", "f2", "n", "rep").join(near.withColumnRenamed("id", "rep"), "rep", "left")
    named = cut(named.select("f1", "f2", "n", F.coalesce("component", "rep").alias("component")), "named")
    discard(classes, near)
    spill_freed(spark)
    names = beside(id_col, ["n_shingles", "component_id", "kept"])
    out = own.join(named, ["f1", "f2", "n"], "left").select("id", F.col("n").cast("long").alias("n"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("c"))
    columns = [F.col("n"), F.col("c"), F.coalesce(F.col("id") == F.col("c"), F.lit(True))]
    return out.select(F.col("id").alias(id_col), *(c.alias(x) for c, x in zip(columns, names, strict=True)))


def op12_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
listed AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
          ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS g FROM listed),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM listed),
met AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS o FROM shingles AS a JOIN shingles AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT i, j FROM met JOIN sizes AS x ON x.doc_id = i JOIN sizes AS y ON y.doc_id = j WHERE 100 * o >= 85 * (x.n + y.n - o)),
both_ways AS (SELECT i, j FROM linked UNION ALL SELECT j, i FROM linked),
reach(id, o) AS (SELECT DISTINCT i, i FROM both_ways UNION SELECT r.id, b.j FROM reach AS r JOIN both_ways AS b ON r.o = b.i),
smallest AS (SELECT id, min(o) AS component FROM reach GROUP BY id)
SELECT s.doc_id, s.n AS n_shingles, coalesce(l.component, s.doc_id) AS component_id, s.doc_id = coalesce(l.component, s.doc_id) AS kept FROM sizes AS s LEFT JOIN smallest AS l ON l.id = s.doc_id
"""
