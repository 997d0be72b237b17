import math
import random
import re
import statistics
from fractions import Fraction

import pytest

from ionweave.llm.quality import FLOORS, MEASURES, base_counts, judge, script_of, vocabularies

public = pytest.importorskip("public_tokenizers")


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = [], 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.append(x)
    spans = {}
    for i in range(len(w) - 7):
        spans.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for at in spans.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(400):
        text = "".join(rnd.choice(["a", "b", "ab", " ", " ", "\n", "\t", "#", "é", "\x0b", "\xa0", "😀", "|"]) for _ in range(rnd.randint(0, 150)))
        assert base_counts(text) == brute(text)
    same = "one two three four five six seven eight nine " * 3
    assert base_counts(same) == brute(same)
    assert base_counts("") == (0, 0, 0, 0, 0)


def test_scripts():
    assert [script_of(x) for x in ("abc é", "абв", "漢字 a", "123 !", "")] == ["LATIN", "CYRILLIC", "CJK", "NONE", "NONE"]


def prose(rnd, n):
    return " ".join(rnd.choice("the of and people water house garden river little morning over under walking said many old young green".split()) for _ in range(n))


def test_verdicts(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, rnd.randint(40, 300)), "en", 1) for i in range(120)]
    rows += [(500, " ".join(chr(0x16A0 + k % 60) * 3 + str(k) for k in range(80)), "en", 1), (501, prose(rnd, 10), "en", 1), (502, prose(rnd, 9) * 9, "en", 1), (503, None, None, 1), (504, "", "en", 1), (505, prose(rnd, 60), None, 1)]
    rows += [(0, rows[0][1], "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    got = judge(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["kept"] for i in range(120)) and by[505]["kept"] and by[505]["band_group"] == "script:LATIN"
    assert not by[500]["base_failed"] and not by[500]["kept"]
    assert all(by[i]["base_failed"] and not by[i]["kept"] for i in (501, 502, 503, 504))
    assert judge(df.limit(0)).count() == 0


def test_entropy_is_held_against_that_of_as_many_tokens(spark):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, rnd.randint(40, 300)), "en") for i in range(200)]
    rows += [(900, " ".join(rnd.choice("the river many house under".split()) for _ in range(120)), "en")]
    by = {r["doc_id"]: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not by[900]["base_failed"] and not by[900]["kept"]
    assert all(by[i]["kept"] for i in range(200))


def test_bands_equal_brute_force_and_do_not_depend_on_tasks(spark):
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefgh 1234#é漢") for _ in range(n))
    rows = [(i, prose(rnd, rnd.randint(10, 200)) + (noise(rnd.randint(0, 200)) if i % 3 == 0 else ""), rnd.choice(["en", "de", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spreads = {"chars_per_token": 2.0, "byte_share": 3.0, "entropy": 2.0}
    got = [sorted(map(tuple, judge(df.repartition(k, "doc_id"), spreads=spreads).collect())) for k in (1, 7)]
    assert got[0] == got[1]
    by = {}
    for r in judge(df, spreads=spreads).collect():
        by.setdefault(r["band_group"], []).append(r)
    kept = 0
    for group in by.values():
        sound = [r for r in group if not r["base_failed"]]
        size = {r["doc_id"]: round(math.log2(max(1, r["n_tokens"])), 6) for r in group}
        bits = {r["doc_id"]: round(r["entropy"] * size[r["doc_id"]], 6) for r in group}
        x, y = [Fraction(size[r["doc_id"]]) for r in sound], [Fraction(bits[r["doc_id"]]) for r in sound]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
        own = {"entropy": lambda r: float(Fraction(bits[r["doc_id"]]) - my - slope * (Fraction(size[r["doc_id"]]) - mx))}  # noqa: B023
        verdict = {r["doc_id"]: not r["base_failed"] for r in group}
        for m in MEASURES:
            step = {r["doc_id"]: round(own.get(m, lambda r: r[m])(r) / 1e-4) for r in group}  # noqa: B023
            middle = statistics.median_low([step[r["doc_id"]] for r in sound])
            mad = statistics.median_low([abs(step[r["doc_id"]] - middle) for r in sound])
            for r in sound:
                verdict[r["doc_id"]] &= abs(step[r["doc_id"]] - middle) <= max(FLOORS[m] / 1e-4, spreads[m] * mad)
        assert all(verdict[r["doc_id"]] == r["kept"] for r in group)
        kept += sum(verdict.values())
    assert 100 < kept < 380


def test_very_long_texts_are_read_whole(spark):
    rnd = random.Random(1)
    texts = [prose(rnd, 50_000), "x" * 300_000, prose(rnd, 40_000) + "y" * 9_000 + prose(rnd, 100), prose(rnd, 60)]
    assert len(texts[0]) > 200_000
    got = {r["doc_id"]: r for r in judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()}
    bytelevel, _, _ = vocabularies(public.path("byte_bpe_multi_50k.tiktoken"), public.path("piece_bpe_32k.model"))
    for i, t in enumerate(texts):
        assert (got[i]["n_tokens"] or 0) == len(bytelevel.encode_ordinary(t))


def test_a_column_named_like_a_result(spark):
    got = judge(spark.createDataFrame([(1, "a b", "en")], "kept long, text string, lang string"), id_col="kept")
    assert got.columns[0] == "kept" and "kept_" in got.columns and got.first()["kept"] == 1
