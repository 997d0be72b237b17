"""Exact top-k search by distributed histogram selection.

Queries and vectors meet in blocks. A round scores every pair of a block with one matrix product and counts each query's
scores in the bins of its current score range; of a block only the bins that can hold the k best of it are sent on. The sum
of a query's histograms over all blocks shows which bin holds its kth best score, and that bin is the next round's
range. Scores are integers, so ranges shrink to one value: the kth best score itself. A last pass keeps what scores at
least that much; a block sends its k best by (score, smaller id), so ties beyond k don't travel.

The set of queries grows with the vectors, so the work is quadratic by contract; neither side is broadcast or collected:
vector blocks and query blocks are shuffled to each other by block numbers, and a task holds one of each. Each round therefore shuffles
every vector once for each block of ``query_block`` queries, and every query once for each block of vectors: larger blocks mean less
traffic and more memory.

Edge cases: vectors that are null, empty, or hold null or non-finite components, those whose squares (after scaling) sum to 2^62 or more,
whose scores might be no longs, and rows without an id take no part. Vectors of one length meet each other only. A query with fewer
than k candidates gets them all. Equal vectors tie and are ordered by id; rows that repeat an id are candidates each and one query, by
their smallest vector; no row with the query's own id is its candidate. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionweave.llm.common import cut, discard, resident, ship, table

#: Doubles hold integers up to this exactly.
EXACT = 2**53


#: A vector takes part if the squares of its components sum to less, so that no score is beyond a long.
LARGEST = 2.0**62


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v, norm) with v an array of longs floor(scale * x), and the sum of their squares; only rows that take part."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite
    whole = F.transform(v, lambda x: F.floor(x * float(scale)).cast("double"))
    rows = df.filter(sound).select(F.col(id_col).cast("long").alias("id"), whole.alias("x"))
    norm = F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.select("id", "x", norm.alias("norm")).filter(F.col("norm") < LARGEST)
    return rows.select("id", F.transform("x", lambda x: x.cast("long")).alias("v"), "norm")


def matrix(pdf: pd.DataFrame, exact: bool) -> np.ndarray:
    m = np.stack([np.asarray(x, dtype=np.int64) for x in pdf["v"]])
    return m.astype(np.float64) if exact else m


def scored(queries: pd.DataFrame, vectors: pd.DataFrame, bound: int):
    """Slices of the score matrix: rows of queries with scores as int64 over all vectors, own id masked out."""
    q, v = matrix(queries, bound < EXACT), matrix(vectors, bound < EXACT)
    qid, vid = queries["id"].to_numpy(np.int64), vectors["id"].to_numpy(np.int64)
    for a in range(0, len(qid), 256):
        s = (q[a : a + 256] @ v.T).astype(np.int64)
        yield slice(a, a + 256), s, qid[a : a + 256, None] != vid[None, :]


def top_k(
    df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, bins: int = 1024, vector_block: int = 4096, query_block: int = 4096
) -> DataFrame:
    """query_id, rank from 1, vec_id, score of the k best of each query row. ``is_query`` is a condition on ``id``."""
    ship(df.sparkSession)
    base = cut(quantised(df, id_col, vec_col, scale), "vectors")
    asking = F.coalesce(is_query, F.lit(False))
    fact = base.agg(F.max("norm").alias("norm"), F.count_if(asking).alias("q")).first()
    if not fact["q"]:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = int(fact["norm"]) + 1
    # blocks of each length of vectors: its rows, and its queries
    blocks = lambda n, size: F.ceil(n / F.lit(float(size))).cast("int")
    sizes = base.groupBy(F.size("v").alias("d")).agg(blocks(F.count("*"), vector_block).alias("n_v"), blocks(F.count_if(asking), query_block).alias("n_q")).filter("n_q > 0")
    sizes = cut(sizes, "sizes")
    dealt = base.withColumn("d", F.size("v")).join(sizes, "d").select("id", "v", "d", "n_q", F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_v")).alias("vb"))
    vectors = dealt.select("id", "v", "d", "vb", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("qb"))
    queries = base.filter(asking).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v")).join(sizes, "d")
    queries = queries.select("id", "v", "d", "n_v", F.pmod(F.xxhash64("id", F.lit(2)), F.col("n_q")).cast("int").alias("qb"))
    queries = cut(queries, "queries")

    def paired(ranges: DataFrame, kernel, schema: str) -> DataFrame:
        """Each query, with its range, against each block of vectors."""
        there = queries.join(ranges, "id").withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_v").cast("long") - 1))).drop("n_v")
        return vectors.groupBy("d", "vb", "qb").cogroup(there.groupBy("d", "vb", "qb")).applyInPandas(kernel, schema)

    def histograms(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        """Counts of the highest bins of a block until they hold k scores; bin ``bins`` stands for all above the range."""
        resident("topk")
        rows = []
        if len(vs) and len(qs):
            low, width = qs["low"].to_numpy(np.int64), qs["width"].to_numpy(np.int64)
            for at, s, other in scored(qs, vs, bound):
                b = np.minimum((s - low[at, None]) // width[at, None], bins)
                b[~other | (b < 0)] = -1
                keep = min(k, b.shape[1])
                for i, row in zip(qs["id"].to_numpy()[at], np.partition(b, b.shape[1] - keep, axis=1)[:, -keep:], strict=True):
                    # counts below the block's own kth bin cannot matter, nor those within it beyond k
                    which, counts = np.unique(row[row >= 0], return_counts=True)
                    rows += [(i, int(w), int(c)) for w, c in zip(which, counts, strict=True)]
        return pd.DataFrame(rows, columns=["id", "bin", "n"])

    def winners(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(vs) and len(qs):
            low, vid = qs["low"].to_numpy(np.int64), vs["id"].to_numpy(np.int64)
            for at, s, other in scored(qs, vs, bound):
                hit = other & (s >= low[at, None])
                for j in range(len(s)):
                    c = np.flatnonzero(hit[j])
                    c = c[np.lexsort((vid[c], -s[j, c]))[:k]]
                    rows += [(qs["id"].iat[at.start + j], vid[x], s[j, x]) for x in c]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    low, width = -bound, -(-(2 * bound + 1) // bins)
    ranges = queries.select(F.col("id").alias("id"), F.lit(low).cast("long").alias("low"), F.lit(width).cast("long").alias("width"))
    ranges = cut(ranges, "ranges")
    while True:
        seen = paired(ranges, histograms, "id long, bin int, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        best = Window.partitionBy("id").orderBy(F.desc("bin"))
        at_kth = seen.withColumn("sum", F.sum("n").over(best)).groupBy("id").agg(F.max(F.when(F.col("sum") >= k, F.col("bin"))).alias("kth"))
        # with fewer than k candidates the range's own low end stays: all of them count
        step = ranges.join(at_kth, "id", "left").select("id", (F.col("low") + F.coalesce("kth", F.lit(0)) * F.col("width")).alias("low"), F.lit(max(1, -(-width // bins))).cast("long").alias("width"))
        before, ranges = ranges, cut(step, "ranges")
        discard(before)
        if width == 1:
            break
        width = max(1, -(-width // bins))
    rows = paired(ranges, winners, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.id AS query_id, b.id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS BIGINT) AS score
           FROM v AS a JOIN v AS b ON a.id % 50 = 0 AND a.id <> b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM scored)
SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score FROM ranked WHERE nth <= 5
"""
