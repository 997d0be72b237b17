from dataclasses import replace

import numpy as np
import pytest
from naive import bfs_components, hamming, partition

from ionweave.config import Settings, from_args, from_ini
from ionweave.operators.cluster import cluster, component_labels, local_labels, medoid_by_pairs, parted
from ionweave.operators.codebook import build
from ionweave.operators.components import components
from ionweave.operators.pairs import pairs, precursor_blocks
from ionweave.operators.prefix import totals_before
from ionweave.schema import ENCODED

S = Settings(hd_dim=64, eps=0.3, precursor_tol=(20.0, "ppm"))


def encoded(spark, n=80, seed=0):
    rng = np.random.RandomState(seed)
    centres = rng.randint(-(2**62), 2**62, 5)
    rows = []
    for k in range(n):
        word = int(centres[rng.randint(5)])
        for _ in range(rng.randint(0, 14)):
            word ^= 1 << int(rng.randint(62))
        rows.append(("f", k, int(2 + k % 2), float(np.float32(500 + rng.randint(3) * 0.005 + rng.randint(2) * 0.2)), k, float(rng.randint(100)), int(rng.randint(2)), [word]))
    return spark.createDataFrame(rows, ENCODED), rows


def by_bucket(rows):
    out = {}
    for r in rows:
        out.setdefault((r[2], r[6]), []).append(r)
    return out


@pytest.mark.parametrize("algorithm", ["dbscan", "hc_single", "hc_complete", "hc_average"])
def test_labels_are_dense_and_blocks_change_nothing(spark, algorithm):
    df, rows = encoded(spark)
    s = replace(S, cluster_alg=algorithm)
    got = {r["spec_index"]: r for r in cluster(df, s).collect()}
    assert len(got) == len(rows)
    for z in (2, 3):
        labels = [got[r[1]]["cluster"] for r in rows if r[2] == z]
        assert set(labels) == set(range(max(labels) + 1))
        reps = [got[r[1]]["cluster"] for r in rows if r[2] == z and got[r[1]]["is_representative"]]
        assert sorted(reps) == sorted(set(labels))
    whole = {r["spec_index"]: r["local"] for r in local_labels(df.selectExpr("*", "0 as block", "'' as part"), s).collect()}
    for own in by_bucket(rows).values():
        ids = [r[1] for r in own]
        a = partition([whole[i] for i in ids])
        b = partition([got[i]["cluster"] for i in ids])
        assert a == b
    again = {r["spec_index"]: r["cluster"] for r in cluster(df.repartition(7), s).collect()}
    assert again == {k: r["cluster"] for k, r in got.items()}


def test_distributed_components_equal_the_kernel(spark):
    df, rows = encoded(spark, seed=4)
    got = {r["spec_index"]: r["component"] for r in component_labels(df, "spec_index", 0.2, 20.0, noise=False).collect()}
    for own in by_bucket(rows).values():
        def linked(x, y, own=own):
            lo, hi = min(x, y), max(x, y)
            far = abs(own[lo][3] - own[hi][3]) * 1e6 >= own[hi][3] * 20.0
            return x != y and not far and hamming(own[x][7], own[y][7]) <= 0.2

        parts = {frozenset(own[k][1] for k in p) for p in bfs_components(len(own), linked)}
        mine = {}
        for r in own:
            mine.setdefault(got[r[1]], set()).add(r[1])
        assert {frozenset(x) for x in mine.values()} == parts
        assert all(min(v) == k for k, v in mine.items())


@pytest.mark.parametrize("algorithm", ["dbscan", "hc_complete"])
def test_large_blocks_go_by_components(spark, algorithm):
    df, rows = encoded(spark, seed=8)
    s = replace(S, cluster_alg=algorithm)
    ids = [r[1] for r in rows]
    flags = lambda got: {i: got[i]["is_representative"] for i in ids}
    a = {r["spec_index"]: r for r in cluster(df, s).collect()}
    b = {r["spec_index"]: r for r in cluster(df, replace(s, max_group=3)).collect()}
    for z in (2, 3):
        own = [r[1] for r in rows if r[2] == z]
        assert partition([a[i]["cluster"] for i in own]) == partition([b[i]["cluster"] for i in own])
        assert {b[i]["cluster"] for i in own} == set(range(max(b[i]["cluster"] for i in own) + 1))
    assert flags(a) == flags(b)


def test_compat_and_wide_threshold_take_whole_buckets(spark):
    df, _ = encoded(spark, 30)
    for s in (replace(S, compat=True), replace(S, eps=1.0)):
        assert cluster(df, s).count() == 30


def test_blocks(spark):
    df = spark.createDataFrame([(2, 1, m) for m in (500.0, 500.005, 500.02, 500.025, 600.0)], "precursor_charge int, bucket int, precursor_mz double")
    got = [r["block"] for r in precursor_blocks(df, 20.0, "ppm").orderBy("precursor_mz").collect()]
    assert got == [0, 0, 1, 1, 2]
    assert [r["block"] for r in precursor_blocks(df, 1.0, "Da").orderBy("precursor_mz").collect()] == [0, 0, 0, 0, 1]


def test_components_of_a_path_a_star_and_a_pair(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7000, 6000), (6000, 7000), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 6000: 6000, 7000: 6000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_medoid_by_pairs(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)], "id long, cluster long")
    d = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 4.0), (8, 9, 2.0), (3, 8, 0.0)], "i long, j long, dist double")
    assert {r["cluster"]: r["id"] for r in medoid_by_pairs(members, d).collect()} == {1: 2, 8: 8}


def test_pair_join_is_an_equi_join(spark):
    df, _ = encoded(spark, 20)
    plan = pairs(df, "spec_index", 20.0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_settings(tmp_path):
    s = from_args(["in", "out", "--eps", "0.2", "--precursor_tol", "10", "Da", "--cluster_charges", "2", "3", "--no-refine", "--rt_tol", "none"])
    assert (s.eps, s.precursor_tol, s.cluster_charges, s.refine, s.rt_tol) == (0.2, (10.0, "Da"), (2, 3), False, None)
    f = tmp_path / "c.ini"
    f.write_text("eps = 0.3\nprecursor_tol = [5, Da]\ncluster_alg = dbscan\n")
    assert from_ini(str(f)) == {"eps": 0.3, "precursor_tol": (5.0, "Da"), "cluster_alg": "dbscan"}
    s = from_args(["in", "out", "-c", str(f), "--eps", "0.1"])
    assert (s.eps, s.cluster_alg) == (0.1, "dbscan")
    for bad in ({"cluster_alg": "x"}, {"scaling": "x"}, {"precursor_tol": (1.0, "x")}, {"mz_binning": "x"}, {"file_type": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_the_commands_of_old_parse():
    a = from_args("in out --cpu_core_preprocess=4 --cluster_alg dbscan --use_gpu_cluster --cluster_charges 2 3 --eps=0.2 --refine".split())
    b = from_args("in out --cpu_core_preprocess=4 --cpu_core_cluster 6 --cluster_alg hc_complete --cluster_charges 2 3 --eps=0.25 --refine".split())
    assert (a.cpu_core_preprocess, a.use_gpu_cluster, a.cluster_alg, a.cluster_charges, a.eps, a.refine) == (4, True, "dbscan", (2, 3), 0.2, True)
    assert (b.cpu_core_cluster, b.use_gpu_cluster, b.cluster_alg) == (6, False, "hc_complete")


def test_vectors_are_shuffled_once(spark):
    df, _ = encoded(spark)
    rows, placed = parted(df, S)
    plan = local_labels(rows, S, placed)._jdf.queryExecution().executedPlan().toString()
    assert placed and plan.count("Exchange hashpartitioning") == 1


def test_totals_before(spark):
    rng = np.random.RandomState(3)
    rows = [(z, int(b), int(k), int(rng.randint(1, 9))) for z in (2, 3) for b in rng.choice(9000, 200, replace=False) for k in range(rng.randint(1, 4))]
    got = totals_before(spark.createDataFrame(rows, "precursor_charge int, bucket int, block int, n long"), "n", "base", ("block",)).collect()
    for z in (2, 3):
        base = 0
        for r in sorted(r for r in rows if r[0] == z):
            assert [g["base"] for g in got if (g["precursor_charge"], g["bucket"], g["block"]) == r[:3]] == [base]
            base += r[3]


def test_a_codebook_too_large_to_broadcast_is_refused():
    with pytest.raises(ValueError, match="codebook"):
        build(Settings(hd_dim=1 << 20, mz_binning="fragment_tol", fragment_tol=0.0001))
