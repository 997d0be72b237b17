from dataclasses import replace

import numpy as np
import pytest
from naive import agglomerate, bfs_components, hamming, partition
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_cluster import S, encoded

from ionweave.operators import kernels, tiles
from ionweave.operators import pairs as pairs_module
from ionweave.operators.cluster import BLOCK, ORDER, cluster, component_labels, grouped, large_clusters, medoid_by_pairs, medoids_by_ones
from ionweave.operators.components import components
from ionweave.operators.pairs import pairs


def vectors(n, seed, words=2, spread=30, kinds=4):
    """Vectors around some centres, with precursors that partly agree."""
    rng = np.random.RandomState(seed)
    centres = rng.randint(-(2**62), 2**62, (kinds, words))
    out = []
    for _ in range(n):
        v = centres[rng.randint(kinds)].copy()
        for _ in range(rng.randint(0, spread)):
            v[rng.randint(words)] ^= np.int64(1) << np.int64(rng.randint(62))
        out.append(v)
    return np.array(out), 500 + rng.randint(0, 12, n) * 0.004


@pytest.fixture
def small_tiles(monkeypatch):
    """Tiles are as small as they are asked to be, so that groups of few rows have many."""
    monkeypatch.setattr(tiles, "PANEL", 0)


def frame(spark, hv, mz, group=None):
    rows = [(2, 7, int(group[k]) if group is not None else 0, k, float(m), [int(x) for x in v]) for k, (v, m) in enumerate(zip(hv, mz, strict=True))]
    return spark.createDataFrame(rows, "precursor_charge byte, bucket int, block int, place long, precursor_mz double, hv array<long>")


def labels_of(found, n):
    got = {r["place"]: r["cluster"] for r in found.collect()}
    assert sorted(got) == list(range(n))
    return [got[k] for k in range(n)]


CASES = [
    ("complete", {"tile": 13, "finish": 0}, "ppm", 20.0, 0.25),
    ("average", {"tile": 13, "finish": 20}, "Da", 0.02, 0.6),
    ("complete", {"tile": 30, "finish": 5}, "ppm", 20.0, 0.6),
]


@pytest.mark.parametrize("method,how,unit,tol,eps", CASES)
def test_linkage_in_rounds_equals_the_kernel(spark, method, how, unit, tol, eps):
    hv, mz = vectors(40, 3)
    dist = kernels.distances(hv.view(np.uint64), mz, tol, unit)
    got = labels_of(tiles.linkage(frame(spark, hv, mz), BLOCK, method, eps, tol, unit, **how), len(hv))
    assert partition(got) == partition(kernels.linkage_cut(dist, eps, method))
    assert all(got[c] == c for c in got)


def test_linkage_of_several_groups_and_of_none(spark):
    hv, mz = vectors(60, 5)
    group = np.arange(60) % 3
    got = labels_of(tiles.linkage(frame(spark, hv, mz, group), BLOCK, "complete", 0.4, None, tile=5, finish=3), 60)
    for g in range(3):
        own = np.flatnonzero(group == g)
        want = kernels.linkage_cut(kernels.distances(hv[own].view(np.uint64), mz[own], None, "ppm"), 0.4, "complete")
        assert partition([got[k] for k in own]) == partition(want)
    assert tiles.linkage(frame(spark, hv[:0], mz[:0]), BLOCK, "complete", 0.4, None).count() == 0


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("method", ["complete", "average"])
def test_mutual_neighbours_merge_as_the_closest_pair_does(seed, method):
    rng = np.random.RandomState(seed)
    d = rng.rand(25, 25)
    d = np.triu(d, 1) + np.triu(d, 1).T
    for eps in (0.2, 0.5, 2.0):
        assert partition(kernels.merged(d.copy(), np.ones(25), eps, method)) == agglomerate(d, eps, method)


def test_ties_have_one_outcome_however_tiles_fall(spark):
    hv, mz = vectors(64, 9, words=1, spread=3, kinds=3)
    one = labels_of(tiles.linkage(frame(spark, hv, mz), BLOCK, "complete", 0.3, None, tile=9, finish=30), 64)
    dist = kernels.distances(hv.view(np.uint64), mz, None, "ppm")
    assert partition(one) == partition(kernels.linkage_cut(dist, 0.3, "complete"))


@pytest.mark.parametrize("tile", [6, 17, 500])
def test_near_pairs(spark, tile):
    hv, mz = vectors(50, 2)
    got = sorted((r["i"], r["j"], r["dist"]) for r in tiles.near_pairs(frame(spark, hv, mz), "place", 0.3, 20.0, tile=tile).collect())
    far = lambda i, j: abs(mz[i] - mz[j]) * 1e6 >= mz[j] * 20.0
    want = [(i, j, hamming(hv[i], hv[j])) for i in range(50) for j in range(i + 1, 50) if not far(i, j) and hamming(hv[i], hv[j]) <= 0.3]
    assert got == want


def test_the_two_sides_of_a_tile_may_have_its_rows_in_any_order(spark, monkeypatch):
    kernels_of = []
    monkeypatch.setattr(tiles, "own_pairs", lambda rows, keys, by, tile, kernel, schema, *more, **how: kernels_of.append(kernel))
    hv, mz = vectors(30, 2)
    df = frame(spark, hv, mz)
    tiles.near_pairs(df, "place", 0.3, 20.0)
    a = df.toArrow()
    b = a.take(np.random.RandomState(1).permutation(30))
    want, got = (sorted(zip(*kernels_of[0](a, x, True).to_pydict().values(), strict=True)) for x in (a, b))
    assert len(want) > 10 and got == want


@pytest.mark.parametrize("tile", [5, 16])
def test_a_forest_connects_what_all_links_do_with_fewer(spark, tile):
    hv, mz = vectors(90, 6)
    links = tiles.forest(frame(spark, hv, mz), "place", 0.45, 20.0, tile=tile)
    dist = kernels.distances(hv.view(np.uint64), mz, 20.0, "ppm")
    want = bfs_components(90, lambda a, b: a != b and dist[a, b] <= 0.45)
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert partition([got.get(k, k) for k in range(90)]) == want
    every = int((dist[np.triu_indices(90, 1)] <= 0.45).sum())
    assert links.count() <= (every if tile == 5 else every / 2)


def test_links_of_one_dense_group_grow_with_its_rows(spark):
    counts = []
    for n in (100, 400):
        hv, mz = vectors(n, 1, kinds=1, spread=4)
        counts.append(tiles.forest(frame(spark, hv, mz), "place", 0.5, None, tile=50).count())
        tiles_of = -(-n // 50)
        assert counts[-1] <= n + tiles_of * tiles_of
    assert counts[1] < 4.5 * counts[0]


def test_a_spanning_forest_has_no_edge_too_many():
    rng = np.random.RandomState(0)
    for _ in range(60):
        near = rng.rand(rng.randint(1, 9), rng.randint(1, 9)) < 0.3
        r, c = near.shape
        edges = tiles.spanning(near)
        whole = bfs_components(r + c, lambda a, b: near[min(a, b), max(a, b) - r] if min(a, b) < r <= max(a, b) else False)
        chosen = {(x, y + r) for x, y in edges}
        assert bfs_components(r + c, lambda a, b: (min(a, b), max(a, b)) in chosen) == whole
        assert len(edges) == r + c - len(whole)


@pytest.mark.parametrize("unit,tol", [("ppm", 20.0), ("Da", 0.02), ("ppm", None), ("ppm", 2e6), ("Da", 0.0), ("ppm", 9.0)])
def test_totals_without_pairs(unit, tol):
    for seed in range(6):
        hv, mz = vectors(60, seed)
        mz = mz + np.random.RandomState(seed).rand(60) * 0.003
        d = kernels.distances(hv.view(np.uint64), mz, tol, unit).astype(np.float64)
        assert kernels.distance_totals(hv.view(np.uint64), mz, tol, unit).tolist() == np.rint(d.sum(axis=1) * 128).astype(int).tolist()


def test_a_known_cluster_is_refined_as_in_its_group():
    hv, mz = vectors(80, 4)
    mz = mz + np.random.RandomState(1).rand(80) * 0.03
    rt = np.random.RandomState(2).rand(80) * 100
    dist = kernels.distances(hv.view(np.uint64), mz, 20.0, "ppm")
    for do_refine in (True, False):
        labels, flags = kernels.settled_group(hv.view(np.uint64), mz, rt, 20.0, "ppm", 40.0, do_refine)
        want = kernels.refine(np.zeros(80, dtype=int), mz, rt, 20.0, "ppm", 40.0) if do_refine else np.zeros(80, dtype=int)
        assert labels.tolist() == want.tolist() and flags.tolist() == kernels.medoids(want, dist).tolist()


def slow_spans(values, tolerance, unit):
    """The closest merge of neighbouring groups, all gaps worked out anew."""
    order = np.argsort(values, kind="stable")
    groups = [[float(values[k])] for k in order]
    span = lambda g: (g[-1] - g[0]) / g[0] * 1e6 if unit == "ppm" and g[0] else g[-1] - g[0]
    while len(groups) > 1:
        gaps = [span(a + b) for a, b in zip(groups, groups[1:], strict=False)]
        k = int(np.argmin(gaps))
        if gaps[k] > tolerance:
            break
        groups[k : k + 2] = [groups[k] + groups[k + 1]]
    out = np.empty(len(values), dtype=int)
    out[order] = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    return out


@pytest.mark.parametrize("unit", [None, "ppm"])
def test_spans_with_ties_equal_those_of_all_gaps(unit):
    rng = np.random.RandomState(7)
    for _ in range(150):
        v = 400 + rng.randint(0, 40, rng.randint(1, 40)) / 256
        tol = rng.choice([0.0, 0.01, 0.03, 0.1]) if unit is None else rng.choice([5.0, 40.0, 150.0])
        assert kernels.span_groups(v, tol, unit).tolist() == slow_spans(v, tol, unit).tolist()


def test_many_spans_take_less_than_a_second():
    import time

    v = 400 + np.random.RandomState(0).rand(30_000) * 100
    began = time.perf_counter()
    found = kernels.span_groups(v, 20.0, "ppm")
    assert time.perf_counter() - began < 1.0
    assert 1000 < found.max() < 30_000


@pytest.mark.parametrize("algorithm", ["dbscan", "hc_complete"])
def test_large_blocks_in_many_tiles(spark, algorithm):
    df, rows = encoded(spark, 120, seed=11)
    s = replace(S, cluster_alg=algorithm)
    place = F.row_number().over(Window.partitionBy(*BLOCK).orderBy(*ORDER)).cast("long")
    blocked = grouped(df, s).withColumn("place", place)
    found = blocked.join(large_clusters(blocked, replace(s, tile=6), finish=4), [*BLOCK, "place"]).collect()
    whole = {r["spec_index"]: r["cluster"] for r in cluster(df, replace(s, refine=False)).collect()}
    for z in (2, 3):
        own = [r for r in found if r["precursor_charge"] == z]
        names: dict = {}
        mine = [names.setdefault((r["bucket"], r["block"], r["cluster"]), len(names)) for r in own]
        assert partition(mine) == partition([whole[r["spec_index"]] for r in own])


@pytest.mark.parametrize("algorithm", ["hc_single", "hc_average"])
def test_large_blocks_are_refined_and_labelled_like_others(spark, algorithm):
    df, rows = encoded(spark, 140, seed=12)
    s = replace(S, cluster_alg=algorithm, rt_tol=60.0)
    a = {r["spec_index"]: r for r in cluster(df, s).collect()}
    b = {r["spec_index"]: r for r in cluster(df, replace(s, max_group=4, tile=7)).collect()}
    assert {k: r["is_representative"] for k, r in a.items()} == {k: r["is_representative"] for k, r in b.items()}
    for z in (2, 3):
        own = [r[1] for r in rows if r[2] == z]
        assert partition([a[i]["cluster"] for i in own]) == partition([b[i]["cluster"] for i in own])
        assert {b[i]["cluster"] for i in own} == set(range(max(b[i]["cluster"] for i in own) + 1))


def test_component_labels_make_no_pair_rows(spark):
    df, rows = encoded(spark, 60, seed=3)
    plan = component_labels(df, "spec_index", 0.2, 20.0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_bits_apart_in_strips():
    rng = np.random.RandomState(5)
    a, b = rng.randint(0, 2**63, (150, 3)).astype(np.uint64), rng.randint(0, 2**63, (70, 3)).astype(np.uint64)
    assert (tiles.bits_apart(a, b) == np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2)).all()


@pytest.mark.parametrize("method", ["complete", "average"])
@pytest.mark.parametrize("finish", [0, 25, 1000])
def test_linkage_over_many_tiles(spark, small_tiles, method, finish):
    hv, mz = vectors(70, 8, spread=40)
    group = np.arange(70) % 2
    got = labels_of(tiles.linkage(frame(spark, hv, mz, group), BLOCK, method, 0.4, 20.0, tile=9, finish=finish), 70)
    for g in range(2):
        own = np.flatnonzero(group == g)
        want = kernels.linkage_cut(kernels.distances(hv[own].view(np.uint64), mz[own], 20.0, "ppm"), 0.4, method)
        assert partition([got[k] for k in own]) == partition(want)


def test_a_forest_over_many_tiles(spark, small_tiles):
    hv, mz = vectors(90, 6)
    dist = kernels.distances(hv.view(np.uint64), mz, 20.0, "ppm")
    got = {r["id"]: r["component"] for r in components(tiles.forest(frame(spark, hv, mz), "place", 0.3, 20.0, tile=11)).collect()}
    assert partition([got.get(k, k) for k in range(90)]) == bfs_components(90, lambda a, b: a != b and dist[a, b] <= 0.3)


def test_small_tiles_are_put_together(spark):
    df = frame(spark, *vectors(300, 1, words=1))
    assert tiles.dealt(df, BLOCK, "place", 2).agg(F.max("_tiles")).first()[0] == 1
    assert tiles.dealt(df, BLOCK, "place", 2, panel=100).agg(F.max("_tiles")).first()[0] == 3


@pytest.mark.parametrize("strip", [40, 1 << 19])
@pytest.mark.parametrize("method", ["complete", "average"])
@pytest.mark.parametrize("seed", range(6))
def test_linkage_without_a_table_equals_the_one_with_it(monkeypatch, strip, method, seed):
    monkeypatch.setattr(tiles, "STRIP", strip)
    monkeypatch.setattr(tiles, "LARGE", 3)
    hv, mz = vectors(90, seed, spread=25, kinds=3)
    x = tiles.Vectors(hv.view(np.uint64), mz, np.arange(90))
    for eps in (0.15, 0.35, 0.6):
        want = kernels.linkage_cut(kernels.distances(hv.view(np.uint64), mz, 20.0, "ppm"), eps, method)
        got = tiles.linked_up(x, np.arange(90), method == "average", eps, 20.0, "ppm")
        assert partition(got.tolist()) == partition(want) and all(got[c] == c for c in got)
        most = tiles.most_bits(128, eps)
        dist = kernels.distances(hv.view(np.uint64), mz, 20.0, "ppm")
        assert partition(tiles.connected(x, most, 20.0, "ppm").tolist()) == partition(kernels.components(dist, eps))


def test_counts_of_distances_and_medoids_without_pairs(spark, small_tiles):
    hv, mz = vectors(80, 3)
    group = np.arange(80) % 3
    df = frame(spark, hv, mz, group)
    every = [(a, b, round(hamming(hv[a], hv[b]) * 128)) for a in range(80) for b in range(a + 1, 80) if group[a] == group[b]]
    want = dict(zip(*np.unique([x for *_, x in every], return_counts=True), strict=True))
    assert {r["bits"]: r["n"] for r in tiles.distance_counts(df, "place", tuple(BLOCK), tile=11).collect()} == want
    distances = spark.createDataFrame([(a, b, float(x)) for a, b, x in every], "i long, j long, dist double")
    members = df.select(F.col("place").alias("id"), F.col("block").alias("cluster"), "hv")
    by_pairs = {r["cluster"]: r["id"] for r in medoid_by_pairs(members, distances).collect()}
    assert {r["cluster"]: r["id"] for r in medoids_by_ones(members).collect()} == by_pairs


def test_a_distance_of_known_length_is_compiled(spark):
    df = frame(spark, *vectors(30, 4))
    slow, fast = (pairs(df, "place", 20.0, words=w) for w in (None, 2))
    assert sorted(slow.collect()) == sorted(fast.collect())
    assert "lambda" not in fast._jdf.queryExecution().executedPlan().toString()


def test_rows_that_are_alike_meet_others_once(spark, monkeypatch):
    hv, mz = vectors(40, 6, words=1)
    hv, mz = np.tile(hv, (5, 1)), np.tile(mz, 5)
    met, forest = [], tiles.forest
    monkeypatch.setattr(tiles, "forest", lambda rows, *more, **how: (met.append(rows.count()), forest(rows, *more, **how))[1])
    got = labels_of(large_clusters(frame(spark, hv, mz), replace(S, cluster_alg="dbscan")), 200)
    assert met[0] <= 40
    assert partition(got) == partition(kernels.components(kernels.distances(hv.view(np.uint64), mz, 20.0, "ppm"), S.eps))


@pytest.mark.parametrize("algorithm", ["dbscan", "hc_single", "hc_complete", "hc_average"])
@pytest.mark.parametrize("table", [3, 30])
def test_a_group_without_a_table_equals_one_with_it(monkeypatch, algorithm, table):
    for seed, do_refine in ((1, True), (2, False)):
        hv, mz = vectors(120, seed, spread=40)
        rt = np.random.RandomState(seed).rand(120) * 100
        how = (hv.view(np.uint64), mz, rt, algorithm, 0.35, 20.0, "ppm", 40.0, do_refine, False)
        monkeypatch.setattr(kernels, "TABLE", 1000)
        want = kernels.cluster_group(*how)
        monkeypatch.setattr(kernels, "TABLE", table)
        got = kernels.cluster_group(*how)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_a_large_group_has_one_table_at_most():
    import tracemalloc

    hv, mz = vectors(2000, 1, words=4, kinds=1, spread=120)
    tracemalloc.start()
    kernels.cluster_group(hv.view(np.uint64), np.full(2000, 500.0), mz, "hc_average", 0.25, 20.0, "ppm", None, True, False)
    assert tracemalloc.get_traced_memory()[1] < 2000 * 2000 * 8 + (24 << 20)
    tracemalloc.stop()


@pytest.mark.parametrize("algorithm", ["hc_complete", "hc_average"])
def test_rows_that_are_alike_are_compared_once(monkeypatch, algorithm):
    hv, mz = vectors(40, 6)
    hv, mz = np.tile(hv, (30, 1)), np.tile(mz, 30)
    how = (hv.view(np.uint64), mz, np.zeros(1200), algorithm, 0.35, 20.0, "ppm", None, False, False)
    monkeypatch.setattr(kernels, "TABLE", 5000)
    want = kernels.cluster_group(*how)
    monkeypatch.setattr(kernels, "TABLE", 1000)
    met, apart = [], tiles.apart
    monkeypatch.setattr(tiles, "apart", lambda a, b: (met.append(a.shape[1] * b.shape[1]), apart(a, b))[1])
    got = kernels.cluster_group(*how)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
    assert sum(met) <= 40 * 40


def test_a_group_that_one_task_ends_has_no_round(spark, monkeypatch):
    hv, mz = vectors(60, 5)
    monkeypatch.setattr(tiles, "over_pairs", None)
    got = labels_of(tiles.linkage(frame(spark, hv, mz), BLOCK, "average", 0.3, 20.0, tile=9, finish=60), 60)
    assert partition(got) == partition(kernels.linkage_cut(kernels.distances(hv.view(np.uint64), mz, 20.0, "ppm"), 0.3, "average"))


@pytest.mark.parametrize("near", [1 << 20, -1])
@pytest.mark.parametrize("seed", range(6))
def test_near_pairs_link_up_as_a_table_does(monkeypatch, near, seed):
    monkeypatch.setattr(tiles, "NEAR", near)
    hv, _ = vectors(30, seed, spread=25)
    hv, n = np.tile(hv, (3, 1)), 90
    rng = np.random.RandomState(seed)
    # masses on the edge, so that the order of two rows decides on whether they agree
    mz = 900 + rng.randint(0, 4, n) * 0.18 + rng.randint(0, 3, n) * 1e-5
    x = tiles.Vectors(hv.view(np.uint64), mz, np.arange(n))
    for method, eps in (("average", 0.2), ("average", 0.5), ("complete", 0.2), ("complete", 0.5)):
        dist = kernels.distances(hv.view(np.uint64), mz, 200.0, "ppm")
        want = kernels.linkage_cut(dist, eps, method)
        least = np.where(np.eye(n, dtype=bool), np.inf, dist)
        i, j = np.divmod(least.argmin(), n)
        begun = np.arange(n)
        begun[max(i, j)] = min(i, j)
        for own in (np.arange(n), begun):
            assert partition(tiles.ended(x, own, method == "average", eps, 200.0, "ppm").tolist()) == partition(want)


@pytest.mark.parametrize("tol,unit", [(20.0, "ppm"), (0.02, "Da"), (None, "Da")])
def test_pairs_of_many_runs(spark, monkeypatch, tol, unit):
    monkeypatch.setattr(pairs_module, "RUN", 4)
    monkeypatch.setattr(pairs_module, "SHARE", 2)
    hv, mz = vectors(70, 4)
    mz[[3, 4]] = np.nan, np.inf
    group = np.arange(70) % 3
    agreed = lambda a, b: tol is None or (abs(mz[a] - mz[b]) < tol if unit == "Da" else abs(mz[a] - mz[b]) * 1e6 < mz[b] * tol)
    want = {(group[a], a, b): hamming(hv[a], hv[b]) for a in range(70) for b in range(a + 1, 70) if group[a] == group[b] and agreed(a, b)}
    got = pairs(frame(spark, hv, mz, group), "place", tol, unit, ("precursor_charge", "bucket", "block")).collect()
    assert {(r["block"], r["i"], r["j"]): r["dist"] for r in got} == pytest.approx(want) and len(got) == len(want)


def test_pairs_of_two_runs_follow_each_other(spark):
    # so that in a file the same few j come again for each i
    rows = spark.range(0, 600_000, 1000).select(F.lit(1).alias("bucket"), "id", F.array(F.col("id")).alias("hv"))
    found = pairs(rows, "id", None, keys=("bucket",), words=1).collect()
    i = np.array([r["i"] for r in found])
    assert len(found) == 600 * 599 // 2
    assert np.diff(np.flatnonzero(np.diff(i, prepend=-1))).max() <= 256
