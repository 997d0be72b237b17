import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ionweave.llm import pii as L


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def only(m):
    return re.sub("[^0-9]", "", m)


PATTERNS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only(m)) <= 19 and luhn(only(m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(m[0]))


def texts(n=1500):
    rnd = random.Random(3)
    parts = [*"ab.@-_+ 0123456789()%", "a@b.co", "1.2.3.4", "+1 555-", "4111111111111111", "😀", "é", "\n", "255.", "x.y@z.w", "4111 1111 1111 1111", "0001."]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_base_spans_equal_plain_patterns(spark):
    rows = list(enumerate([*texts(), "", None, "a@" * 3000, "1 " * 8000, "x" * 50000, "mail a@b.co, " * 4000, "+1" + "-" * 3000]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", L.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(x["start"], x["kind"], x["end"]) for x in r["s"]] == brute(rows[r["doc_id"]][1] or "")


def corpus():
    """Filler, and a name that stands beside one address in several different contexts and nowhere else."""
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(12))) for i in range(400)]
    docs += [(1000 + i, f"{' '.join(rnd.choice(words) for _ in range(5))} Zebulon write {['to', 'at', 'me', 'us'][i]} zeb@example.com {rnd.choice(words)} tail{chr(97 + i)}") for i in range(4)]
    docs += [(2000 + i, "The same copied line with Quixote here q@example.com and more") for i in range(30)]
    return docs


def test_terms_that_disclose_are_spans_and_copies_alone_are_not(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {r["id"]: r for r in L.all_spans(df, "doc_id", "text").collect()}
    for i in range(1000, 1004):
        assert {x["value"].lower() for x in got[i]["more"]} == {"zebulon", "write"}
    assert all(not got[i]["more"] for i in got if i < 1000 or i >= 2000)


def test_terms_of_entities_in_one_or_two_documents_far_off_or_in_repeated_blocks(spark):
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    far = " ".join(rnd.choice(words) for _ in range(200))
    block = "yours Wu Ferdinando mail f@example.com"
    docs = [(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(3000)]
    docs += [(5000, f"Zebulon {far} z@example.com")] + [(5100 + i, f"{far} {rnd.choice(words)} Li {far} l@example.com") for i in range(2)]
    docs += [(6000 + i, f"{' '.join(rnd.choice(words) for _ in range(30))} {block}") for i in range(20)]
    got = {r["id"]: {x["value"].lower() for x in r["more"]} for r in L.all_spans(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[5000] == {"zebulon"} and got[5100] == got[5101] == {"li"}
    assert all(got[6000 + i] == {"yours", "wu", "ferdinando", "mail"} for i in range(20))
    assert not any(got[i] for i in range(3000))


def test_sanitise_keeps_rows_and_columns(spark):
    rows = [*[(i, t, 7) for i, t in corpus()], (5000, None, 1), (5001, "", 2), (None, "mail a@b.co or +1 (555) 123-4567", 3), (None, "mail a@b.co or +1 (555) 123-4567", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = L.sanitise(df)
    assert got.columns == df.columns
    found = got.collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r["text"] for r in found if r["doc_id"] is not None}
    assert by[5000] is None and by[5001] == "" and by[0] == dict(corpus())[0]
    assert "zeb" not in by[1000].lower() and "[EMAIL]" in by[1000]
    # rows without an id are documents like others, and these two words stand in no other text
    assert [r["text"] for r in found if r["doc_id"] is None] == ["[WORD] [EMAIL] [WORD] [PHONE]"] * 2


def spans_of(rows):
    return sorted((r["id"], [(x["kind"], x["start"], x["value"]) for x in r["more"]]) for r in rows)


def test_a_table_with_every_row_twice_has_the_same_terms(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    once = spans_of(L.all_spans(df, "doc_id", "text").collect())
    assert any(x for _, x in once)
    assert spans_of(L.all_spans(df.unionByName(df), "doc_id", "text").collect()) == sorted(once * 2)


def test_each_of_two_texts_of_an_id_keeps_its_own(spark):
    rows = [*corpus(), (1000, "0123456789 abcdefghij klmnopqrst uvwxyz and mail to a@b.co"), (1000, "0123456789 abcdefghij klmnopqrst uvwxyz")]
    got = [r["text"] for r in L.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == 1000]
    assert "0123456789 abcdefghij klmnopqrst uvwxyz" in got
    assert len(got) == 3 and sum("zeb@" in t for t in got) == 0


def test_an_entity_held_three_times_by_one_document_is_held_once(spark):
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta"]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, line(20)) for i in range(400)]
    docs += [(500, f"Zebulon z@e.com {line(30)} Zebulon z@e.com {line(30)} Zebulon z@e.com"), (501, f"Zebulon {line(9)}"), (502, f"Zebulon {line(8)}")]
    got = {r["id"]: {x["value"] for x in r["more"]} for r in L.all_spans(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()}
    assert "Zebulon" not in got[500]


def brute_terms(texts, generalise=0.9, z=L.Z):
    """{text: terms} by counting every pair of a word and a value."""
    import math

    words = lambda t: set(re.findall(r"[^\W\d_]+", t.lower()))
    entities = {t: {(k, t[a:b].lower()) for a, k, b in brute(t)} for t in set(texts)}
    without = {t: words(re.sub(PATTERNS[0][0], " ", t)) for t in set(texts)}
    n, out = len(texts), {}
    for t in set(texts):
        for c in entities[t]:
            n_c = sum(c in entities[x] for x in texts)
            for w in without[t]:
                both = [x for x in texts if c in entities[x] and w in without[x]]
                n_t = sum(w in words(x) for x in texts)
                p, size = min(1.0, len(both) / n_t), n_t * len(set(both)) / len(both)
                low = (p + z * z / (2 * size) - z * math.sqrt(p * (1 - p) / size + z * z / (4 * size * size))) / (1 + z * z / size)
                if n_c < n and low > 0 and math.log2(low / (n_c / n)) / -math.log2(n_c / n) >= generalise:
                    out.setdefault(t, set()).add(w)
    return out


def test_terms_equal_brute_force(spark):
    rnd = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    rows = []
    for i in range(300):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12)))
        if i % 5 == 0:
            k = rnd.randrange(12)
            t += f" person{chr(97 + k)} p{k}@x.org" + (f" town{chr(97 + k)}" if rnd.random() < 0.6 else "")
        rows += [(i, t)] * rnd.choice([1, 1, 1, 2])
    want = brute_terms([t for _, t in rows])
    assert len(want) > 20
    got = L.all_spans(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    texts = dict(rows)
    base = {i: brute(t) for i, t in rows}
    for r in got:
        t = texts[r["id"]]
        spots = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in want.get(t, ())]
        free = [(a, b) for a, b in spots if not any(s < b and a < e for s, _, e in base[r["id"]])]
        assert sorted((x["start"], x["end"]) for x in r["more"]) == free


def test_terms_are_generalised_by_their_form(spark):
    df = spark.createDataFrame([("Anna works at IBM daily",)], "t string")
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(4).alias("kind"), F.lit(b).alias("end"), F.lit(v).alias("value")) for a, b, v in [(0, 4, "Anna"), (14, 17, "IBM"), (18, 23, "daily")]))
    assert df.select(L.redacted(F.col("t"), spans)).first()[0] == "[NAME] works at [ACRONYM] [WORD]"


def test_overlapping_spans_become_one(spark):
    df = spark.createDataFrame([("0123456789",)], "t string")
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(k).alias("kind"), F.lit(b).alias("end"), F.lit("").alias("value")) for a, k, b in [(1, 0, 4), (3, 1, 6), (7, 5, 8)]))
    assert df.select(L.redacted(F.col("t"), spans)).first()[0] == "0[EMAIL]689"


@pytest.mark.parametrize("n", [0, 3])
def test_query_columns(spark, tmp_path, n):
    rows = [(1, "a@b.co 1.2.3.4", "en", "s", 14), (2, None, None, None, None), (2, "", None, None, 0)][:n]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(L.op2_pii(spark, str(tmp_path)).collect(), key=lambda r: (r["doc_id"], r["n_email"]))
    assert len(got) == n
    if n:
        assert (got[0]["n_email"], got[0]["n_ip"], got[0]["n_card"], got[0]["n_phone"], got[0]["spans"]) == (1, 1, 0, 0, "email:0:6,ip:7:14")
        assert got[0]["base_sha256"] == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
        assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = L.all_spans(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
