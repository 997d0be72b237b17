import hashlib
import math
import random

import numpy as np
import pytest

from ionweave.llm.codes import Assigner, rounded_down, rounded_up, vector_codes


def brute(rows, parts=16, entries=64, rounds=2):
    """Lloyd's rounds without bounds, in Python's integers; {(id, vector): (code, error, label_error)} as a list, and the digest."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v, v + [0] * (parts * w - len(v)), lab) for i, v, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(r[2], p) for r in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        codes = [[min((apart(cut(r[2], p), e), j) for j, e in enumerate(books[p])) for p in range(parts)] for r in kept]
        if k < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    own = [cut(r[2], p) for r, c in zip(kept, codes, strict=True) if c[p][1] == j]
                    if own:
                        books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in c) for c in codes]
    label = {}
    for r, e in zip(kept, errors, strict=True):
        label[r[3]] = label.get(r[3], 0) + e
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in c), e, label[r[3]], digest) for r, c, e in zip(kept, codes, errors, strict=True)), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, lab, "x", 0) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    return sorted((tuple(r) for r in vector_codes(df, **how).collect()), key=repr)


def some(n, dims, seed=0, values=(-1.0, -0.5, -0.126, 0.0, 0.25, 0.5)):
    rnd = random.Random(seed)
    return [(i, [rnd.choice(values) for _ in range(dims)], rnd.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize(("dims", "how"), [(32, {}), (12, {"parts": 4, "entries": 5, "rounds": 4}), (8, {"parts": 4, "entries": 3, "rounds": 0}), (6, {"parts": 1, "entries": 256})])
def test_equals_plain_rounds_with_many_ties(spark, dims, how):
    rows = some(90, dims)
    assert run(spark, rows, **how) == brute(rows, **how)


def test_spread_values(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 3) for _ in range(16)], i % 3) for i in range(150)]
    how = {"parts": 4, "entries": 20, "rounds": 6}
    assert run(spark, rows, **how) == brute(rows, **how)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(30, 8) + [(50, None, 1), (51, [1.0, None] * 4, 1), (52, [nan] * 8, 1), (53, [inf] * 8, None), (None, [0.5] * 8, 2), (54, [], 0), (55, [1.0, 2.0, 3.0], 0), (3, [0.5] * 8, 1), (3, [0.5] * 8, 1)]
    how = {"parts": 4, "entries": 7}
    assert run(spark, rows, **how) == brute(rows, **how)
    assert run(spark, some(3, 8), **how) == brute(some(3, 8), **how)


def test_equal_vectors_take_the_first_entry(spark):
    got = run(spark, [(i, [0.5] * 16, 0) for i in range(70)])
    assert {r[1] for r in got} == {"00" * 16} and {r[2] for r in got} == {0}


def test_empty_tables_and_names(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, 0)]) == []
    df = spark.createDataFrame([(1, [1.0, 2.0], 0)], "error long, v array<double>, l int")
    out = vector_codes(df, "error", "v", "l", parts=2, entries=2)
    assert out.columns == ["error", "code", "error_", "label_error", "codebooks_sha256"] and out.count() == 1


def test_vectors_whose_errors_might_be_no_longs_take_no_part(spark):
    rows = some(20, 4) + [(30, [3.0e38, 0.0, 0.0, 0.0], 0), (31, [3.0e6, 0.0, 0.0, 0.0], 0), (32, [1.0e6, -1.0e6, 0.0, 0.0], 0)]
    assert run(spark, rows, parts=2, entries=4) == brute([r for r in rows if r[0] not in (30, 31)], parts=2, entries=4)


def test_bounds_hold_and_spare_distances():
    rnd = np.random.RandomState(1)
    v = rnd.randint(-300, 300, (400, 3, 4)) + 4000 * rnd.randint(0, 6, (400, 1, 1))
    books = np.ascontiguousarray(v[:30].transpose(1, 0, 2))
    assigner = Assigner(books)
    code, upper, lower, _ = assigner.assign(v, *assigner.first(v))
    upper, lower = rounded_up(upper).astype(float), rounded_down(lower).astype(float)
    after = books + rnd.randint(-40, 40, books.shape)
    second = Assigner(after, books)
    code, upper, lower, error = second.assign(v, code, upper, lower)
    apart = ((v[:, :, None, :] - after[None]) ** 2).sum(-1)
    assert (code == apart.argmin(axis=2)).all() and (error == apart.min(axis=2).sum(axis=1)).all()
    assert (lower <= np.sqrt(apart)).all() and (upper >= np.sqrt(apart.min(axis=2))).all()
    assert second.worked < v.shape[0] * 3 * 30 / 2


def test_bounds_are_rounded_to_the_safe_side():
    x = np.abs(np.random.RandomState(0).standard_cauchy(5000)) * 100
    assert (rounded_down(x).astype(float) <= x).all() and (rounded_up(x).astype(float) >= x).all()
    assert rounded_down(np.array([1e9]))[0] == 65504
