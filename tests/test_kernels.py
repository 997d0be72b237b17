import numpy as np
import pytest
from naive import agglomerate, bfs_components, hamming, partition

from ionweave.operators import kernels as K


def random_group(seed, n=14, words=2):
    rng = np.random.RandomState(seed)
    centres = rng.randint(0, 2**63, (3, words), dtype=np.int64)
    hv = centres[rng.randint(0, 3, n)].copy()
    for row in hv:
        for _ in range(rng.randint(0, 30)):
            row[rng.randint(words)] ^= np.int64(1) << np.int64(rng.randint(62))
    return hv.view(np.uint64), 500 + rng.rand(n) * 0.05, rng.rand(n) * 900


@pytest.mark.parametrize("unit,tol", [("ppm", 20.0), ("Da", 0.02), ("ppm", 1e9)])
def test_distances(unit, tol):
    hv, mz, _ = random_group(1)
    got = K.distances(hv, mz, tol, unit)
    for x in range(len(hv)):
        assert got[x, x] == 0
        for y in range(x + 1, len(hv)):
            gap = abs(mz[x] - mz[y])
            far = gap >= tol if unit == "Da" else gap * 1e6 >= mz[y] * tol
            assert got[x, y] == got[y, x] == pytest.approx(1.0 if far else hamming(hv[x], hv[y]), abs=1e-6)


@pytest.mark.parametrize("seed", range(25))
@pytest.mark.parametrize("eps", [0.1, 0.2, 0.4])
def test_clusterings_equal_naive_ones(seed, eps):
    hv, mz, _ = random_group(seed)
    dist = K.distances(hv, mz, 60.0, "ppm").astype(float) + np.triu(np.random.RandomState(seed).rand(14, 14) * 1e-6, 1)
    dist = np.triu(dist, 1) + np.triu(dist, 1).T
    parts = bfs_components(len(dist), lambda a, b: a != b and dist[a, b] <= eps)
    assert partition(K.components(dist, eps)) == parts
    assert partition(K.dbscan(dist, eps)) == parts
    for method in ("complete", "average"):
        assert partition(K.linkage_cut(dist, eps, method)) == agglomerate(dist, eps, method)


def test_chain_is_one_for_single_and_more_for_complete():
    d = np.abs(np.arange(5.0)[:, None] - np.arange(5.0)[None, :])
    assert len(set(K.components(d, 1.0))) == 1
    assert len(set(K.linkage_cut(d, 1.0, "complete"))) == 3


@pytest.mark.parametrize("unit", [None, "ppm"])
def test_span_groups_keep_to_the_tolerance(unit):
    rng = np.random.RandomState(3)
    for _ in range(100):
        v = 400 + np.round(rng.rand(rng.randint(1, 12)) * 0.1, 4)
        tol = 0.02 if unit is None else 50.0
        got = K.span_groups(v, tol, unit)
        for g in set(got.tolist()):
            own = v[got == g]
            span = own.max() - own.min()
            assert (span if unit is None else span / own.min() * 1e6) <= tol + 1e-9
    assert K.span_groups(np.array([]), 1.0).tolist() == []
    # by the gaps alone these would be one group
    assert len(set(K.span_groups(np.array([0.0, 0.9, 1.8, 2.7]), 1.0).tolist())) == 2


def test_refine_splits_by_mass_and_time():
    labels = np.array([0, 0, 0, 0, 1, 1, -1, 2])
    mz = np.array([500, 500.001, 510, 510.001, 600, 650, 700, 700.0])
    rt = np.zeros(8)
    assert K.refine(labels, mz, rt, 20.0, "ppm", None).tolist() == [0, 0, 1, 1, -1, -1, -1, -1]
    rt = np.array([0, 100, 0, 1, 0, 0, 0, 0.0])
    assert K.refine(labels, mz, rt, 20.0, "ppm", 10.0).tolist() == [-1, -1, 0, 0, -1, -1, -1, -1]


def test_compat_time_key_collides_and_the_pair_does_not():
    # groups by mass 3 and 0, by time 0 and 2: 2a + 3b is 6 for both
    mz = np.repeat([100.0, 200.0, 300.0, 400.0, 100.0], [2, 2, 2, 2, 2])
    rt = np.array([1000, 1000, 2000, 2000, 2000, 2000, 0, 0, 3000, 3000.0])
    labels = np.zeros(10, dtype=int)
    assert len(set(K.refine(labels, mz, rt, 20.0, "ppm", 10.0).tolist())) == 5
    assert len(set(K.refine(labels, mz, rt, 20.0, "ppm", 10.0, compat=True).tolist())) <= 5


def test_medoids():
    d = np.array([[0, 1, 4, 9], [1, 0, 1, 9], [4, 1, 0, 9], [9, 9, 9, 0.0]])
    assert K.medoids(np.array([0, 0, 0, -1]), d).tolist() == [False, True, False, True]
    assert K.medoids(np.array([0, 0, -1, -1]), d).tolist() == [True, False, True, True]
    # the live choice takes a place in the subset for one in the bucket
    far_first = d[::-1, ::-1]
    assert K.medoids(np.array([-1, 0, 0, 0]), far_first, compat=True).tolist() == [True, True, False, False]
    assert K.medoids(np.array([-1, 0, 0, 0]), far_first).tolist() == [True, False, True, False]
