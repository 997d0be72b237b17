import math

import pytest
from pyspark.sql import functions as F

from ionweave.config import Settings
from ionweave.functions import peaks as P
from ionweave.operators.clean import clean, size_histogram
from ionweave.schema import RAW


def one(spark, expr, peaks, **more):
    rows = [([tuple(map(float, p)) for p in peaks], *more.values())]
    kinds = ", ".join([f"peaks {P.PEAKS}", *(f"{k} double" if isinstance(v, float) else f"{k} int" for k, v in more.items())])
    got = spark.createDataFrame(rows, kinds).select(expr.alias("x")).first()["x"]
    return [tuple(p) for p in got] if isinstance(got, list) and got and hasattr(got[0], "mz") else got


def test_mz_range_is_inclusive(spark):
    assert one(spark, P.mz_range("peaks", 101.0, 1500.0), [(100.99, 1), (101, 1), (1500, 1), (1500.01, 1)]) == [(101, 1), (1500, 1)]
    assert len(one(spark, P.mz_range("peaks", None, None), [(1, 1), (9999, 1)])) == 2


@pytest.mark.parametrize("n,end,ok", [(5, 350.0, True), (4, 350.0, False), (5, 349.9, False), (0, 0, False)])
def test_validity(spark, n, end, ok):
    peaks = [(100 + k, 1) for k in range(n - 1)] + [(end, 1)] if n else []
    assert one(spark, P.is_valid("peaks", 5, 250.0), peaks) is ok


def test_precursor_goes_at_every_charge(spark):
    m, z = 500.0, 3
    targets = [((m - 1.007825) * z) / c + 1.007825 for c in (1, 2, 3)]
    peaks = sorted([(t + 1.5, 1) for t in targets] + [(t - 1.6, 1) for t in targets])
    got = one(spark, P.remove_precursor("peaks", "m", "z", 1.5), peaks, m=m, z=z)
    assert [round(p[0], 6) for p in got] == sorted(round(t - 1.6, 6) for t in targets)
    assert len(one(spark, P.remove_precursor("peaks", "m", "z", 1.5), [(500, 1)], m=m, z=0)) == 1


def test_threshold_is_strict_and_ties_go_to_lower_mz(spark):
    assert one(spark, P.most_intense("peaks", 50, 0.01), [(1, 100), (2, 1), (3, 1.01)]) == [(1, 100), (3, 1.01)]
    assert one(spark, P.most_intense("peaks", 2, 0.0), [(1, 5), (2, 7), (3, 5)]) == [(1, 5), (2, 7)]
    assert one(spark, P.most_intense("peaks", 2, 0.0), []) == []


def test_scaling_and_norm(spark):
    p = [(1, 4.0), (2, 9.0), (3, 1.0)]
    assert [x[1] for x in one(spark, P.scale("peaks", "root"), p)] == [2, 3, 1]
    assert [x[1] for x in one(spark, P.scale("peaks", "log"), p)] == pytest.approx([math.log2(5), math.log2(10), 1])
    assert [x[1] for x in one(spark, P.scale("peaks", "rank", 50), p)] == [49, 50, 48]
    assert [x[1] for x in one(spark, P.scale("peaks", "root", max_intensity=6.0), p)] == [4, 6, 2]
    with pytest.raises(Exception, match="max_rank"):
        one(spark, P.scale("peaks", "rank", 2), p)
    assert sum(x[1] ** 2 for x in one(spark, P.unit_norm("peaks"), p)) == pytest.approx(1)
    assert [x[1] for x in one(spark, P.unit_norm("peaks"), [(1, 0.0)])] == [0]


def test_buckets(spark):
    rows = [(300.148804, 2, 598), (1796.564697, 3, 5384)]
    got = spark.createDataFrame(rows, "m double, z int, want int").select(P.bucket("m", "z", 1).alias("b"), "want").collect()
    assert all(r["b"] == r["want"] for r in got)
    half = 1.00794 + 2.5 * 1.0005079  # half to even
    assert spark.createDataFrame([(half, 1)], "m double, z int").select(P.bucket("m", "z", 1)).first()[0] in (2, 3)


def test_bins():
    assert P.bin_count(101.0, 1500.0, 0.05) == 27981
    assert P.bin_count(101.0, 1500.0, 1.0) == 1400


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_clean_drops_and_keeps(spark):
    good = [(110.0 + 60 * k, 10.0 + k) for k in range(8)]
    few = good[:4]
    s = Settings(cluster_charges=(2,))
    rows = [("f", 0, 2, 800.0, 1, 1.0, good), ("f", 1, 2, 800.0, 2, 1.0, few), ("f", 2, 3, 800.0, 3, 1.0, good), ("f", 3, 2, 800.0, 4, 1.0, [])]
    got = clean(raw(spark, rows), s).collect()
    assert [r["spec_index"] for r in got] == [0]
    assert sum(p["intensity"] ** 2 for p in got[0]["peaks"]) == pytest.approx(1)
    assert clean(raw(spark, []), s).count() == 0


def test_clean_works_the_peaks_out_once(spark):
    plan = clean(raw(spark, [("f", 0, 2, 800.0, 1, 1.0, [(1.0, 1.0)])]), Settings())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_size_histogram(spark):
    df = spark.range(10).select(F.lit(2).alias("precursor_charge"), F.when(F.col("id") < 7, 1).otherwise(F.col("id")).alias("bucket"))
    got = {r["bin"]: r["buckets"] for r in size_histogram(df, (0, 2, 5, 7)).collect()}
    assert got == {0: 3, 2: 1}
