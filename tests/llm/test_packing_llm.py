import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ionweave.llm.packing import Packer, Piece, pack
from ionweave.llm.words import loaded


@pytest.fixture(scope="module")
def vocab():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(vocab):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


TEXTS = ["", None, "hello world", "It's Ünï-cödé 12,5 — don't", "Σίσυφος İstanbul", "a\u0301 e\u0301", "漢字 😀 \u200b x\x1cy", "<|endoftext|> mid <|startoftext|>", "²³ ª º µ ½", "word " * 9000, "x" * 3000]


def test_ids_equal_the_library(vocab, library):
    got = [np.frombuffer(b, "<u4").tolist() for b in loaded(vocab).encode_all([t or "" for t in TEXTS])]
    assert got == [library(t) for t in TEXTS]


def test_every_id_once_and_all_limits_kept(spark, library):
    rows = [(i, t, "p q" if i % 2 else None, 5) for i, t in enumerate(TEXTS * 3)] + [(None, "no id", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, head string, length int")
    got = pack(df, prompt_col="head", max_tokens=512, max_segments=7, max_loss=400, window=4, with_ids=True).toPandas()
    assert got[got["doc_id"].isna()].length.sum() == len(library("no id")) + 1
    for i, g in got.dropna(subset="doc_id").sort_values("start").groupby("doc_id"):
        text, head = rows[int(i)][1], rows[int(i)][2]
        ids = library(head) + library(text) + [2]
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            part = ids[at : at + r.length]
            assert list(r.ids) == part and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        assert g.loss_tokens.sum() == len(ids) - len(library(head))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 512 and len(g) <= 7 and g.loss_tokens.sum() <= 400
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]


def power(n):
    return n & (n - 1) == 0


def test_no_padding_however_many_tasks(spark):
    rows = [(i, "some words of text " * (1 + i * 37 % 400)) for i in range(300)] + [(i, "one") for i in range(300, 900)]
    for tasks in (1, 64):
        df = spark.createDataFrame(rows, "doc_id int, text string").repartition(tasks, "doc_id")
        got = pack(df)
        assert dict(got.dtypes)["doc_id"] == "int"
        by = got.groupBy("sequence_id").agg({"length": "sum", "loss_tokens": "sum", "*": "count"}).toPandas()
        assert all(n == 4096 or power(n) for n in by["sum(length)"])
        assert by["sum(loss_tokens)"].max() <= 4064 and by["count(1)"].max() <= 32
        if tasks == 1:
            # limits bind: some sequences are full of segments or of loss, before they are full of ids
            assert (by["count(1)"] == 32).any() and (by["sum(length)"] == 4096).sum() > len(by) / 2
        assert got.count() == got.dropDuplicates(["doc_id", "start"]).count()


def naive(pieces, limits, window, last=False):
    """The heuristic by plain loops over exact numbers; pieces are (row, start, size, free)."""
    out, waiting = [], []

    def take(p, n):
        row, start, size, free = p
        return (row, start, n, min(n, free)), (row, start + n, size - n, max(0, free - n))

    def head(p, tokens, loss):
        return min(p[2], tokens, p[3] + loss)

    def demand(p):
        return (p[2], 1, p[2] - p[3])

    def fill(leave):
        nonlocal waiting
        while len(waiting) > leave:
            room, sequence = list(limits), []
            weights = [Fraction(sum(demand(p)[d] for p in waiting), len(waiting)) / limits[d] ** 2 for d in range(3)]
            while waiting and room[0] and room[1]:
                score = lambda k: sum(w * r * x for w, r, x in zip(weights, room, demand(waiting[k])))  # noqa: B023, E731
                every = range(len(waiting))
                whole = [k for k in every if all(x <= r for x, r in zip(demand(waiting[k]), room))] if room[1] > 1 else []
                k = max(whole or every, key=lambda k: (score(k), -k))
                n = head(waiting[k], room[0], room[2])
                if not n:
                    free = [k for k in every if head(waiting[k], room[0], 0)]
                    if not free:
                        break
                    k = free[0]
                    n = head(waiting[k], room[0], 0)
                first, rest = take(waiting[k], n)
                sequence.append(first)
                room = [r - x for r, x in zip(room, demand(first))]
                if rest[2]:
                    waiting[k] = rest
                else:
                    del waiting[k]
            total = sum(p[2] for p in sequence)
            if total == limits[0]:
                out.append(sequence)
                continue
            while total:  # powers of two, the largest first
                size = max(2**k for k in range(20) if 2**k <= total)
                total -= size
                some = []
                while size:
                    first, rest = take(sequence[0], min(size, sequence[0][2]))
                    sequence = ([rest] if rest[2] else []) + sequence[1:]
                    some.append(first)
                    size -= first[2]
                out.append(some)

    for p in pieces:
        while p[2] > limits[0]:
            first, p = take(p, head(p, limits[0] - limits[0] // 16, limits[2]))
            waiting.append(first)
        waiting.append(p)
        if len(waiting) >= 2 * window:
            fill(window)
    fill(0)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_a_naive_packer(seed):
    rnd = random.Random(seed)
    limits = rnd.choice([(64, 5, 50), (128, 4, 127), (64, 64, 64), (32, 3, 20)])
    sizes = [rnd.choice([1, 2, rnd.randint(1, 30), rnd.randint(1, 90), rnd.randint(1, 300)]) for _ in range(60)]
    free = [min(n, rnd.choice([0, 1, 4, 4, 4, 400])) for n in sizes]
    packer = Packer(*limits, window=7)
    got = [s for k, (n, f) in enumerate(zip(sizes, free)) for s in packer.add(Piece(k, b"", 0, n, f, n))] + list(packer.flush())
    want = naive([(k, 0, n, f) for k, (n, f) in enumerate(zip(sizes, free))], limits, 7)
    assert [[(p.row, p.start, p.size, p.free) for p in s] for s in got] == want
    assert sum(p.size for s in got for p in s) == sum(sizes)


def test_names_types_and_very_long_texts(spark):
    df = spark.createDataFrame([("a", "word " * 60_000), ("b", None), (None, "x")], "start string, text string")
    got = pack(df, id_col="start").toPandas()
    assert list(got.columns)[:2] == ["start", "start_"]
    assert got[got.start == "a"].length.sum() == 60_001 and got[got.start == "b"].length.sum() == 1 and got.start.isna().sum() >= 1


def test_packer_with_a_tight_loss_limit():
    packer = Packer(10, 3, 4, 2)
    pieces = [Piece(k, b"", 0, n, free, n) for k, (n, free) in enumerate([(9, 0), (3, 3), (25, 5), (1, 0), (10, 10), (2, 1)])]
    out = [s for p in pieces for s in packer.add(p)] + list(packer.flush())
    assert all(sum(p.size for p in s) <= 10 and len(s) <= 3 and sum(p.loss for p in s) <= 4 for s in out)
    assert sum(p.size for s in out for p in s) == sum(p.size for p in pieces)
    with pytest.raises(ValueError):
        Packer(0, 1, 1, 1)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
