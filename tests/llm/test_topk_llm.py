import math

import pytest
from pyspark.sql import functions as F

from ionweave.llm.topk import top_k


def brute(rows, is_query, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if is_query(q):
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k=5, **how):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, id string, score int")
    got = top_k(df, F.col("id") % 5 == 0, k=k, **how)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def some(n, seed=0, dims=6):
    import random

    rnd = random.Random(seed)
    return [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.5]) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"vector_block": 7, "query_block": 3, "bins": 4}, {"k": 1}, {"k": 200}])
def test_equals_brute_force_with_many_ties(spark, how):
    rows = some(60)
    assert run(spark, rows, **how) == brute(rows, lambda q: q % 5 == 0, how.get("k", 5))


def test_odd_vectors_take_no_part(spark):
    rows = some(20) + [(20, None), (25, []), (30, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (35, [float("nan")] * 6), (40, [float("inf")] * 6), (None, [1.0] * 6)]
    assert run(spark, rows) == brute(rows, lambda q: q % 5 == 0, 5)


def test_one_vector_repeated(spark):
    rows = [(i, [0.5] * 6) for i in range(40)]
    got = run(spark, rows, vector_block=8)
    assert [r for r in got if r[0] == 0] == [(0, k + 1, k + 1, 6 * 128 * 128) for k in range(5)]


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_vectors_of_one_length_meet_each_other_only(spark):
    rows = some(30) + [(100 + i, v) for i, v in some(30, 1, 4)] + [(300, [1.0] * 9)]
    want = sorted(brute(rows[:30], lambda q: q % 5 == 0, 5) + brute(rows[30:60], lambda q: q % 5 == 0, 5))
    assert run(spark, rows, vector_block=11, query_block=2) == want


def test_vectors_whose_scores_might_be_no_longs_take_no_part(spark):
    rows = some(20) + [(50, [3.0e38] + [0.0] * 5), (55, [1.0e6] * 6), (56, [-1.0e6] * 6)]
    assert run(spark, rows) == brute([r for r in rows if r[0] != 50], lambda q: q % 5 == 0, 5)
    assert run(spark, [(0, [3.0e38, 1.0]), (5, [-3.0e38, 0.0])]) == []
