import random

import numpy as np
import pytest

from test_jaccard_llm import corpus, edited, sets

from ionweave.llm import chunks, nearcopies
from ionweave.llm.chunks import Layout, chunk_keys, parity, remaining, wide_parity
from ionweave.llm.nearcopies import near_copies, similar


def brute(rows, k, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, sets(t, k)) for i, t in rows if i is not None]
    for x, (i, a) in enumerate(known):
        for j, b in known[:x]:
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(sets(t, k)), None if i is None else root(i), i is None or root(i) == i) for i, t in rows), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, component_id string, n_shingles int")
    return sorted((tuple(r) for r in near_copies(df, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"few": 0, "depth": 2}, {"percent": 70, "k": 2}, {"few": 0, "depth": 0}])
def test_equals_brute_force(spark, how):
    rows = corpus(4)
    assert run(spark, rows, **how) == brute(rows, how.get("k", 3), how.get("percent", 85))


def test_nulls_repeated_ids_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (None, "a b c d"), (3, "a b c d"), (3, "e f g h"), (4, "e f g h"), (5, "A b C d"), (None, None), (6, " \t"), (7, "x"), (8, "X")]
    assert run(spark, rows) == brute(rows, 3, 85)
    assert run(spark, []) == []


def test_names(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "KEPT long, text string")
    assert near_copies(df, "KEPT").columns == ["KEPT", "n_shingles", "component_id", "kept_"]


def random_set(rnd, n):
    return np.unique(rnd.randint(0, 2**63 - 1, n).astype(np.uint64))


@pytest.mark.parametrize("percent", [50, 75, 85, 97])
def test_similar_sets_share_a_key_at_every_depth(percent):
    rnd, layout = np.random.RandomState(percent), Layout(percent)
    tried = 0
    for _ in range(1500):
        a = random_set(rnd, int(np.exp(rnd.uniform(0.5, 6.5))))
        most = len(a) * (100 - percent) // percent
        b = np.union1d(rnd.permutation(a)[: len(a) - rnd.randint(0, most + 1)], random_set(rnd, rnd.randint(0, most + 1)))
        if not similar(a, b, percent) or np.array_equal(a, b):
            continue
        tried += 1
        bands = {layout.band(len(a)), layout.band(len(a)) + 1} & {layout.band(len(b)), layout.band(len(b)) + 1}
        found = []
        for band in bands:
            x, y = chunk_keys(a, layout, band), chunk_keys(b, layout, band)
            assert len(x) == layout.keys(band)
            found += [(band, int(p)) for p in np.flatnonzero(x == y)]
        assert found
        band, place = found[rnd.randint(len(found))]
        assert max(len(a), len(b)) <= layout.lows[band + 1] - 1
        path = [place]
        for depth in (1, 2):
            x, y = (chunk_keys(remaining(s, layout, band, path), layout, band, depth, 77) for s in (a, b))
            same = np.flatnonzero(x == y)
            assert same.size
            path.append(int(rnd.choice(same)))
    assert tried > 200


def test_bands_hold_similar_sizes():
    layout = Layout(85)
    for n in range(1, 3000):
        for m in range(n, n * 100 // 85 + 1):
            assert layout.band(m) - layout.band(n) in (0, 1)
            assert 15 * (n + m) // 185 <= layout.threshold(layout.band(m))
    assert layout.found(10, 0)[0] == layout.band(10) and layout.found(10, 10**6) is None


def test_parity_sketch_is_a_lower_bound():
    rnd = np.random.RandomState(2)
    for n in (3, 50, 2000):
        a = random_set(rnd, n)
        b = np.union1d(a[: n // 2], random_set(rnd, 7))
        assert int(np.bitwise_count(parity(a) ^ parity(b)).sum()) <= len(np.setxor1d(a, b))
    a = random_set(rnd, 3000)
    folded = wide_parity(a).reshape(2, -1)
    assert (folded[0] ^ folded[1] == parity(a, 2048)).all() and wide_parity(a[:1024]).size == 0 and wide_parity(a[:1025]).size == 32


def test_a_passage_of_many_documents_makes_few_pairs(spark, monkeypatch):
    """Documents of 4 of 12 passages and few words of their own: what leaves the joins grows with the documents."""
    seen = []
    real = nearcopies.cut
    for module in (nearcopies, chunks):
        monkeypatch.setattr(module, "cut", lambda df, name: seen.append((name, (out := real(df, name)).count())) or out)
    total = []
    for n in (100, 400):
        rnd = random.Random(7)
        passages = [[f"p{j}w{x}" for x in range(25)] for j in range(12)]
        docs = [" ".join(w for j in rnd.sample(range(12), 4) for w in passages[j]) + " " + " ".join(f"o{i}x{x}" for x in range(18)) for i in range(n)]
        seen.clear()
        got = run(spark, list(enumerate(docs)))
        assert got == brute(list(enumerate(docs)), 3, 85)
        total.append(sum(c for name, c in seen if name in ("stars", "pairs", "open", "refined", "known")))
    assert total[1] < 8 * max(total[0], 1)


def test_a_large_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    rows = [(i, edited(base, rnd, rnd.randint(2, 9))) for i in range(250)]
    assert run(spark, rows) == run(spark, rows, few=0, depth=1) == brute(rows, 3, 85)
