import random
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from ionweave.llm.toxicity import CURVE, Matcher, Model, drop_toxic, fit_curve, fold, learn, most_specific, op10_toxicity, score, sigmoid, stems

public = pytest.importorskip("public_tokenizers")


LEXICON = {f" {fold(w)}": 5.0 for w in ("idiot", "clown", "trash")}


def test_folding():
    assert fold("IDIOT") == fold("1d10t") == fold("іdіоt") == fold("ｉｄｉｏｔ")
    assert fold("$tup1d") == fold("stupid") and fold("l0ser") == fold("loser")
    assert fold("call 555 1234 $5 @") == fold("CALL") + " 555 1234 $5 @"
    assert fold("") == ""


def test_long_runs_are_read_once():
    began = time.process_time()
    for text in ("a" * 300_000, "!" * 300_000, "1" * 300_000, "a1" * 150_000, "idiot" * 60_000):
        fold(text)
        Matcher(LEXICON, ()).measure(text)
    assert time.process_time() - began < 20


def test_matches_count_once_a_word_and_exceptions_do_not():
    m = Matcher({" idi": 2.0, f" {fold('idiot')} ": 5.0, f" {fold('clown')} ": 4.0}, ("clown fish",))
    assert m.measure("An idiot, idiom.") == (7.0, 3)
    assert m.measure("clown fish and a clown") == (4.0, 5)
    assert m.measure("") == (0.0, 0)


def naive_measure(text, weights, exceptions):
    """Word by word: the heaviest stem of each, unless an exception phrase covers it."""
    words = "".join(c if c.isalpha() else " " for c in fold(text)).split()
    phrases = [fold(e).split() for e in exceptions]
    exempt = {i + k for p in phrases for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p for k in range(len(p))}
    heaviest = [max([weights[s] for s in weights if (f" {w} " == s if s.endswith(" ") else f" {w} ".startswith(s))], default=0.0) for w in words]
    return sum(h for i, h in enumerate(heaviest) if i not in exempt), len(words)


def test_matcher_equals_naive_scoring():
    rnd = random.Random(12)
    syllables = ["ka", "l1", "so", "$o", "ne", "idi", "ot", "1d10t", "іd", "cl0wn", "fish", "tr@sh", "!", "-", "  ", "\n", "7", "é"]
    vocabulary = [fold("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))).strip() for _ in range(300)]
    words = [w for w in vocabulary if w.isalpha()]
    weights = {s: float(rnd.randint(1, 9)) for w in rnd.sample(words, 30) for s in [rnd.choice(stems(w))]}
    exceptions = tuple(f"{rnd.choice(words)} {rnd.choice(words)}" for _ in range(60))
    model = Model(weights, exceptions, (-1.0, 0.7, 9.0))
    texts = ["".join(rnd.choice(syllables + [" "] * 8 + [w + " " for w in words[:40]]) for _ in range(rnd.randint(0, 120))) for _ in range(300)]
    texts += [" ".join(rnd.choice(exceptions) for _ in range(rnd.randint(1, 30))) for _ in range(50)]
    m = Matcher(weights, exceptions)
    want = [naive_measure(t, weights, exceptions) for t in texts]
    assert [m.measure(t) for t in texts] == want
    assert sum(w > 0 for w, _ in want) > 100
    x = np.array([[1.0, np.log1p(a), a / max(b, 20)] for a, b in want])
    assert np.allclose(model.scores(texts), sigmoid(x @ np.array(model.curve)))


def test_exceptions_and_stems_are_learned_by_counting(spark):
    rows, labels = corpus(600)
    docs = [(i, t + (" seen on grumpkin hill today" if not y and i % 20 == 1 else "")) for (i, t, *_), (_, _, y) in zip(rows, labels)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = learn(frame, spark.createDataFrame([(i, y) for i, _, y in labels], "doc_id long, toxic int"))
    assert fold("grumpkin hill") in model.exceptions and fold("on grumpkin") in model.exceptions
    truth = [y for _, _, y in labels]
    got = model.scores([t for _, t in docs]) >= 0.3
    assert sum(g != y for g, y in zip(got, truth)) <= 6
    # the weights, by counting
    known = [(t, y) for (i, t), y in zip(docs, truth) if zlib.crc32(str(i).encode()) % 4 != 2]
    has = [({s for w in set(fold(t).split()) if len(w) > 2 for s in stems(w)}, y) for t, y in known]
    n = [sum(1 - y for _, y in has), sum(y for _, y in has)]
    for s, w in model.weights:
        x = [sum(s in h for h, y in has if y == k) for k in (0, 1)]
        assert np.isclose(w, np.log((x[1] + 0.5) / (n[1] + 1)) - np.log((x[0] + 0.5) / (n[0] + 1)))


def test_very_long_texts_and_taken_names(spark):
    rows, labels = corpus(300)
    docs = [(i, t, 0.5) for i, t, *_ in rows] + [(5000, " ".join(t for _, t, *_ in rows) * 60, 0.5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    model = learn(frame, spark.createDataFrame([(i, y) for i, _, y in labels] + [(5000, 0)], "doc_id long, toxic int"))
    got = score(frame, model)
    assert got.columns == ["doc_id", "text", "score", "score_"]
    assert got.filter("score_ between 0 and 1 and score = 0.5").count() == len(docs)


def test_scores_fall_with_length_and_are_shares():
    model = Model(LEXICON)
    s = model.scores(["you idiot", "you idiot " + "fine words here " * 200, "fine words", "", None])
    assert s[0] > s[1] > s[2] and s[3] == s[4] and ((s >= 0) & (s <= 1)).all()


def test_longer_stems_stand_for_shorter_ones():
    assert most_specific({" tra": (7.0, 100), " trash ": (7.0, 98), " pre": (5.0, 60), " pref ": (5.0, 10)}) == {" trash ": 7.0, " pre": 5.0, " pref ": 5.0}


def test_curve():
    assert fit_curve(np.zeros(5), np.ones(5), np.zeros(5)) == CURVE
    rng = np.random.RandomState(0)
    y = rng.randint(0, 2, 500)
    w = fit_curve(y * 5.0 * rng.rand(500), np.full(500, 50.0), y)
    assert w[1] + w[2] > 0


def corpus(n=600):
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in ("mor", "len", "tas", "wor", "hap") for b in ("ka", "li", "so", "ne", "tu", "vi")]
    bad = ["grumpkin", "snarfle"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [rnd.choice(words) for _ in range(rnd.randint(15, 60))]
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs, labels = corpus()
    docs += [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "no id here", "en", "s", 1), (3, docs[3][1], "en", "s", 1)]
    labels += [(3, 1, 0), (7, 1, 1), (8, 1, None), (None, 1, 1)]  # 7 is labelled both ways
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    return str(top)


def test_held_out_rows_are_found(spark, tables):
    got = op10_toxicity(spark, tables).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: y for i, _, y in corpus()[1]}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth) / len(held) > 0.97


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    models = []
    for turn in (False, True):
        frame = spark.createDataFrame([(i, 1 - y if turn and held(i) else y) for i, _, y in labels], "doc_id long, toxic int")
        models.append(learn(docs, frame))
    without = learn(docs, spark.createDataFrame([(i, y) for i, _, y in labels if not held(i)], "doc_id long, toxic int"))
    assert sum(held(i) for i, *_ in labels) > 80
    assert models[0].weights == models[1].weights == without.weights and models[0].curve == models[1].curve == without.curve


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot moron", 2), (2, "a fine day", 3)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = learn(docs, none)
    assert model.curve == CURVE and not model.weights and not model.exceptions
    kept = drop_toxic(docs, none)  # nothing is known to be toxic
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert score(docs.limit(0), model, out_col="s").count() == 0


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, tables), name)
        assert docs.columns == columns
    ids = [r["doc_id"] for r in docs.collect()]
    assert 0 not in ids and 1 in ids and 9000 in ids and ids.count(3) == 1 and ids.count(None) == 1
    out = corpus_pipeline.run(spark, tables)
    pieces = out.toPandas()
    assert set(pieces.doc_id.dropna()) == {i for i in ids if i is not None}
    assert all(len(i) == n for i, n in zip(pieces.ids, pieces.length))


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
