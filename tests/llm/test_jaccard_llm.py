import random
import re

import numpy as np
import pytest

from ionweave.llm import jaccard
from ionweave.llm.jaccard import Index, commonness, jaccard_components, levels, one_of_each, shingle_sets


def sets(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, sets(t)) for i, t in rows if i is not None]
    for x, (i, a) in enumerate(known):
        for j, b in known[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def edited(words, rnd, n):
    w = list(words)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=0):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage = text(60)
    docs = []
    for _ in range(25):
        base = text(rnd.randint(5, 150))
        docs += [" ".join(base)] + [edited(base, rnd, rnd.randint(0, 4)) for _ in range(rnd.randint(0, 4))]
    base = text(120)
    docs += [edited(base, rnd, rnd.randint(0, 5)) for _ in range(60)]  # one large group, not all linked to each other
    docs += [" ".join(base)] * 15
    docs += [" ".join(text(rnd.randint(20, 60)) + passage) for _ in range(40)]  # a passage that many share
    docs += ["", "  \t\n", "one", "One", "a b c d", "A  b\tc d", "a b c d e", "a b c e d", "É b c d e", "é b c d e", "a\u00a0b c d e f", "x " * 400, "X " * 300]
    rnd.shuffle(docs)
    return list(enumerate(docs))


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, id string, n int")
    got = jaccard_components(df, **how).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
    return got


@pytest.mark.parametrize("seed,block", [(0, 2048), (1, 5)])
def test_equals_brute_force(spark, seed, block):
    rows = corpus(seed)
    got = check(spark, rows, block_size=block)
    texts = dict(rows)
    assert all(r["n_shingles"] == len(sets(texts[r["doc_id"]])) for r in got)


def test_salted_elements_lose_no_link(spark):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = [*enumerate(edited(base, rnd, 2) for _ in range(90)), *((100 + i, " ".join(rnd.choice("abcdefghijklmnop") for _ in range(50))) for i in range(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = commonness(df, "text", 5)
    dealt = [levels(s, sketch, 8)[1] for s in shingle_sets([t for _, t in rows[:90]], 5)]
    assert sum((d > 1).sum() for d in dealt) > 1000  # most elements are salted
    check(spark, rows, hot=8, block_size=7)


def templates(seed, own):
    """Documents of a passage that all share and words of their own, of which ``own`` draws the number."""
    rnd = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([f"o{rnd.randrange(10**9)}" for _ in range(own(rnd))] + passage) for _ in range(120)]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,low,high", [(0, 4, 14), (2, 0, 25)])
def test_templates_about_the_threshold(spark, seed, low, high):
    check(spark, templates(seed, lambda rnd: rnd.randint(low, high)), block_size=16)


def test_halves_of_several_passages(spark):
    rnd = random.Random(5)
    passages = [[f"p{j}x{k}" for k in range(25)] for j in range(6)]
    rows = [(i, " ".join(sum(rnd.sample(passages, 2), [f"o{i}x{k}" for k in range(rnd.randint(0, 6))]))) for i in range(120)]
    check(spark, rows, block_size=16)


def test_searches_grow_with_the_documents_not_with_their_pairs(spark, monkeypatch):
    made = {}

    def counted(*args):
        out = placed(*args)
        made[n] = made.get(n, 0) + out.count()
        return out

    placed = jaccard.placed
    monkeypatch.setattr(jaccard, "placed", counted)
    rnd = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(38))
    for n in (200, 400):  # similarity 0.68, no link
        rows = [(i, " ".join(f"o{rnd.randrange(10**9)}" for _ in range(8)) + " " + passage) for i in range(n)]
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert all(r["component_id"] == r["doc_id"] for r in got)
    assert made.get(400, 0) <= 400 and made.get(400, 0) <= 2 * made.get(200, 0) + 8
    made.clear()
    for n in (200, 400):  # links, but few to the document of the smallest id
        rows = [(i, " ".join(f"o{rnd.randrange(10**9)}" for _ in range(rnd.randint(0, 25) if i else 25)) + " " + passage) for i in range(n)]
        check(spark, rows)
    assert made[400] <= 3 * made[200]


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None), (None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f"), (4, "")]
    got = check(spark, rows)
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got) == [(-1, 2, None), (1, 0, 1), (2, 2, 2), (2, 2, 2), (3, 2, 2), (4, 0, 4)]
    assert check(spark, []) == []


def test_one_of_each(spark):
    rows = [(5, "a b c d e f", 1), (3, "A b c d e f", 2), (3, "A b c d e f", 2), (7, "other words stand here instead", 3), (None, "a b c d e f", 4), (8, None, 5), (9, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _keep int")
    got = one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 3, 7, 8, 9]


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", 1), (1, "entirely different words stand here instead", 2), (1, "alpha beta gamma delta epsilon zeta", 0),
        (2, "alpha beta gamma delta epsilon zeta", 3), (3, "Entirely different words stand here instead", 4), (4, None, 5), (4, "", 6), (5, "x", 7), (None, "x", 8),
    ]
    got = sorted(map(tuple, one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()), key=repr)
    assert got == sorted([rows[2], rows[1], (4, None, 5) if (4, None, 5) in got else (4, "", 6), rows[7], rows[8]], key=repr)
    again = sorted(map(tuple, one_of_each(spark.createDataFrame(rows[::-1], "doc_id long, text string, n int").repartition(5)).collect()), key=repr)
    assert again == got


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "n_shingles long, text string")
    assert jaccard_components(df, "n_shingles").columns == ["n_shingles", "n_shingles_", "component_id"]


def test_search_equals_counting():
    rng = np.random.RandomState(0)
    base = rng.randint(0, 2**62, 60).astype(np.uint64)
    some = [np.unique(np.concatenate([base[rng.rand(60) < 0.9], rng.randint(0, 2**62, rng.randint(0, 12)).astype(np.uint64)])) for _ in range(80)]
    index = Index(list(range(80)), some)
    for i, q in enumerate(some):
        want = {j for j, s in enumerate(some) if j != i and 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))}
        assert set(index.search(q, 75, False, i)) == want
        first = index.search(q, 75, True, i)
        assert len(first) == min(1, len(want)) and set(first) <= want


def test_sets_do_not_depend_on_their_company():
    texts = ["a b c d e f g", "", None, "short one", "long " * 3000, "a b c d e f g"]
    together = list(shingle_sets(texts, 5))
    for t, s in zip(texts, together):
        assert (next(shingle_sets([t], 5)) == s).all() and len(s) == len(sets(t))
