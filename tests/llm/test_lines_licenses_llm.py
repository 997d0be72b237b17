import random
import re

import xxhash
from pyspark.sql import functions as F

from ionweave.llm.licenses import GAP, TEMPLATES, TEXTS, bigram_hash, scan, template_bigrams
from ionweave.llm.linededup import drop_repeated_lines, without_repeats

BLANKS = " \t\r\x0b\x0c"


def brute(rows):
    """The text of each row after removal; a row is known by its id and its text."""
    later = {}
    key = lambda i, t: (i, xxhash.xxh64((t or "").encode(), seed=42).intdigest())
    signed = lambda k: (k[0], k[1] - 2**64 if k[1] >= 2**63 else k[1])
    windows = {}
    for i, t in rows:
        if i is None:
            continue
        full = [(k, x.strip(BLANKS)) for k, x in enumerate((t or "").split("\n")) if x.strip(BLANKS)]
        for j in range(len(full) - 2):
            windows.setdefault(tuple(x for _, x in full[j : j + 3]), []).append((signed(key(i, t)), j, [k for k, _ in full[j : j + 3]]))
    for found in windows.values():
        first = min(f[:2] for f in found)
        for k, j, lines in found:
            if (k, j) != first:
                later.setdefault(k, set()).update(lines)
    out = []
    for i, t in rows:
        gone = later.get(signed(key(i, t)), set()) if i is not None else set()
        out.append(t if not gone else "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone))
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, "\n".join(rnd.choice(["a", "b", " a ", "", "c d", "e\t", "long line of words", " "]) for _ in range(rnd.randint(0, 12)))) for i in range(120)]
    rows += [(500, "x1\nx2\nx3\nx4\nx5"), (501, "y\nx1\nx2\nx3\nx4\nx5\nz"), (502, None), (503, ""), (None, "x1\nx2\nx3"), (504, "x1\nx2"), (505, "\n" * 3000)]
    df = spark.createDataFrame([(i, t, n, 0) for n, (i, t) in enumerate(rows)], "doc_id long, text string, covered int, _id int")
    got = {r["covered"]: r["text"] for r in without_repeats(df).collect()}
    assert [got[n] for n in range(len(rows))] == brute(rows)
    kept = drop_repeated_lines(df)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {500, 501, 502, 503, 504, 505, None} <= ids
    assert without_repeats(df.limit(0)).count() == 0


def test_a_copy_goes_and_repeated_ids_stay(spark):
    text = "first line\nsecond line\nthird line\nfourth line"
    df = spark.createDataFrame([(1, text), (2, text), (1, text)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in drop_repeated_lines(df).collect()) == [1, 1]


def test_two_texts_of_one_id_lose_only_what_they_repeat(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "keep me\nand me\nme too\nlast"), (2, "a\nb\nc\nown"), (2, "a\nb"), (2, "x\ny\nz"), (2, "w\nx\ny\nz")]
    got = sorted(r["text"] for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute(rows))
    assert "keep me\nand me\nme too\nlast" in got and "own" in got and "a\nb\nc\nd" in got


def test_very_long_texts(spark):
    rows = [(1, "\n".join(f"line {k}" for k in range(60000))), (2, "\n".join(f"line {k}" for k in range(30000, 60002))), (3, "z" * 3_000_000)]
    got = {r["doc_id"]: r for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 30000 and got[2]["text"] == "line 60000\nline 60001" and got[3]["text"] == rows[2][1]


def test_no_python_in_the_plans(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    for x in (without_repeats(df), scan(df)):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def brute_scan(text):
    """Every unit against every template, without pruning."""
    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    grams = lambda w: set(zip(w, w[1:]))
    units = [("line", k, grams(words(x))) for k, x in enumerate(text.split("\n"))]
    units += [("paragraph", k, grams(words(x))) for k, x in enumerate(re.split("\n[ \t\r]*\n", text)) if "\n" in x]
    out = []
    for kind, nth, a in units:
        best = None
        for name, b in BIGRAMS.items():
            dice = 2 * len(a & b) / (len(a) + len(b))
            if 200 * len(a & b) >= 80 * (len(a) + len(b)) and (best is None or dice > best[0]):
                best = (dice, name)
        if best:
            out.append((kind, nth, best[1], round(best[0], 6)))
    w, runs = words(text), []
    for name, b in BIGRAMS.items():
        run = []
        for i in [i for i in range(len(w) - 1) if (w[i], w[i + 1]) in b] + [10**9]:
            if run and i - run[-1] > GAP:
                a = grams(w[run[0] : run[-1] + 2])
                if 200 * len(a & b) >= 80 * (len(a) + len(b)):
                    runs.append((run[0], run[-1], 2 * len(a & b) / (len(a) + len(b)), name))
                run = []
            run.append(i)
    for x in runs:
        around = [y for y in runs if y is not x and y[0] <= x[0] and y[1] >= x[1]]
        if all(y[:2] == x[:2] and (y[2], x[3]) < (x[2], y[3]) for y in around):
            out.append(("run", x[0], x[3], round(x[2], 6)))
    return sorted(out)


def test_notices_beside_common_words_are_found(spark):
    texts = [
        "See the terms of the agreement. Licensed under the Apache License, Version 2.0. See the file in the root of the source distribution for the rest of the terms.",
        "The text of the work. This work is licensed under the GNU General Public License, version 3. The rest of the terms of the work are in the file.",
    ]
    got = scanned(spark, texts)
    assert any(k == "run" and "apache" in lic for k, _, lic, _ in got[0]) and any(k == "run" and lic == "gpl-3.0-notice" for k, _, lic, _ in got[1])
    for n, t in enumerate(texts):
        assert sorted(got[n]) == brute_scan(t)


BIGRAMS = {name: set(template_bigrams(t)) for name, t in sorted(TEMPLATES.items())}


def scanned(spark, texts):
    got = {}
    for r in scan(spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, license string")).collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["nth"], r["license"], r["dice"]))
    return got


def test_scan_equals_brute_force(spark):
    rnd = random.Random(8)
    texts = []
    for t in TEMPLATES.values():
        w = t.split()
        for _ in range(4):
            x = [y for y in w if rnd.random() > 0.04]
            text = "".join(y + rnd.choice([" ", " ", " ", "\n"] if len(w) > 12 else [" "]) for y in x)
            texts.append(f"Some prose before.\n\n{text.upper() if rnd.random() < 0.3 else text}\n \nAnd after it.")
        texts.append(f"A longer line of prose says this much: {t} And then it goes on as prose does, without end.")
    texts += [None, "", "word", "two words", "the " * 5000, "é ü ß"]
    got = scanned(spark, texts)
    for n, t in enumerate(texts):
        assert sorted(got.get(n, [])) == brute_scan(t or "")
    assert len(got) >= 100
    assert all(any(k == "run" for k, *_ in got[n]) for n in range(4, len(TEMPLATES) * 5, 5))
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_notices_and_very_long_texts(spark):
    notice = "Released under the MIT License."
    long = " ".join(f"w{k % 977} x y of the" for k in range(120_000))
    texts = [f"{notice} {notice}", f"{long} {TEXTS['mit']} {long}", long]
    got = scanned(spark, texts)
    assert {x[2] for x in got[0]} == {"mit-notice"} and any(x[0] == "line" and x[3] == round(8 / 9, 6) for x in got[0])
    assert [(k, lic) for k, _, lic, _ in got[1]] == [("run", "mit")]
    assert 2 not in got


def test_the_plan_is_the_same_for_any_number_of_templates(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    rnd = random.Random(3)
    many = {f"t{k}": " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 5) for _ in range(40)) for k in range(300)}
    sizes = [len(scan(df, templates=t)._jdf.queryExecution().analyzed().toString().split("\n")) for t in (None, many)]
    assert sizes[0] == sizes[1]
    assert "from_json" not in scan(df)._jdf.queryExecution().optimizedPlan().toString()


def test_hashes_are_those_of_spark(spark):
    pairs = [("a", "b"), ("mit", "license"), ("0", "z9")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    assert all(r["h"] == bigram_hash(r["a"], r["b"]) for r in got)
