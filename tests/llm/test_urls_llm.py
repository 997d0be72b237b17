import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ionweave.llm.urls import RULES, judge

URLS = [
    "http://A.Example.COM/en/1?x", "https://www.example.com/en/2", "http://example.com/en/x#y", "http://example.com/en", "http://shop.net/es/9.html", "http://shop.net/fr/", "http://shop.net/de/7",
    "http://com/", "http://com", "ftp://x.org", "no scheme", "", None, "http://h://x/y", "http://Ünï.NET/es/é", "//x.com/", "a://b.com/?q=/en/", "http://x.notcom/", "http://example.com:80/en/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(t, v) for t, v in RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return host, path, max(fits, key=lambda r: len(r[0]), default=(None, None))


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, path int")


def test_hosts_paths_and_rules(spark):
    got = judge(frame(spark, URLS * 2)).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, (rule, said) = brute((URLS * 2)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (said or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_template_with_blocked_pages_is_rejected_and_others_are_not(spark):
    # numbers are wildcards, so pages under one template share its labels; a rule on a longer beginning labels only some
    rules = (("bad.org/list/1", "block"), ("bad.org/news/1", "allow"))
    urls = [f"http://bad.org/list/{k}" for k in range(100, 200)] + ["http://bad.org/list/77", "http://bad.org/news/77", "http://other.org/list/77", "http://bad.org/free/1"] + [f"http://bad.org/news/{k}" for k in range(100, 150)]
    got = {u: r for u, r in zip(urls, sorted(judge(frame(spark, urls), rules=rules).collect(), key=lambda r: r["page_id"]))}
    assert got["http://bad.org/list/77"]["verdict"] == "block" and got["http://bad.org/list/77"]["rule"] is None
    assert {got[u]["verdict"] for u in ("http://bad.org/news/77", "http://other.org/list/77", "http://bad.org/free/1")} == {"allow"}
    r = got["http://bad.org/list/77"]
    prior = 100 / 150
    assert (r["template"], r["template_purity"]) == ("/list/*", pytest.approx((100 + 4 * prior) / 104, abs=1e-6))


def test_alike_branches_merge_and_places_of_many_kinds_are_wildcards(spark):
    rules = (("s.org/a/x", "block"), ("s.org/b/x", "block"), ("s.org/c/x", "allow"), ("s.org/a/y", "allow"), ("s.org/b/y", "allow"))
    urls = [f"http://s.org/{b}/{w}" for b in "ab" for w in ("x1", "x2", "y1", "y2")] + [f"http://s.org/c/x{k}" for k in range(40)] + [f"http://v.org/{w}{w}k" for w in "abcdefghijklmnop"]
    got = {u: r["template"] for u, r in zip(urls, sorted(judge(frame(spark, urls), rules=rules).collect(), key=lambda r: r["page_id"]))}
    assert got["http://s.org/c/x1"].startswith("/c/") and got["http://s.org/a/x1"].startswith("/a/") and got["http://s.org/b/y1"].startswith("/b/")
    assert {t for u, t in got.items() if "v.org" in u} == {"/*"}


def test_branches_without_labels_merge_with_labelled_ones_built_like_them(spark):
    rules = (("x.org/es/", "block"), ("x.org/fr/", "block"), ("y.org/", "block"))
    urls = [f"http://x.org/{b}/{k}" for b in ("es", "fr", "de") for k in range(10)] + [f"http://x.org/big/{k}" for k in range(90)] + [f"http://x.org/about/{w}" for w in ("us", "you", "them", "all", "it", "me", "we", "he", "she", "one")]
    urls += [f"http://y.org/{k}" for k in range(200)] + ["http://z.org/only/1"]
    got = {u: r for u, r in zip(urls, sorted(judge(frame(spark, urls), rules=rules).collect(), key=lambda r: r["page_id"]))}
    assert {(got[f"http://x.org/de/{k}"]["template"], got[f"http://x.org/de/{k}"]["verdict"]) for k in range(10)} == {("/*/*", "block")}
    assert {r["verdict"] for u, r in got.items() if "/big/" in u or "/about/" in u} == {"allow"}
    # the corpus' share of blocked pages is 1, and says nothing of a template without labels
    assert got["http://z.org/only/1"]["verdict"] == "allow"


def naive(urls, rules, children=12, variety=0.5, z=1.96, weight=4.0, purity=0.8):
    """Templates and verdicts by a tree of dictionaries, level by level to the end of every path."""
    pages = [(h, p, *max([(t, v) for t, v in rules if (h == t.split("/", 1)[0] or h.endswith("." + t.split("/", 1)[0])) and p.startswith("/" + t.split("/", 1)[1])], key=lambda r: len(r[0]), default=(None, None))) for h, p, _ in map(brute, urls)]
    paths = {}
    for h, p, _, said in pages:
        x = paths.setdefault((h, p), {"n": 0, "labelled": 0, "blocked": 0, "t": "", "s": [("*" if re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]+)?", s) or (re.fullmatch(r"[0-9a-fA-F-]{8,}", s) and re.search("[0-9]", s)) else s) for s in p.split("/") if s]})
        x["n"] += 1
        x["labelled"] += said is not None
        x["blocked"] += said == "block"
    for level in range(max(len(x["s"]) for x in paths.values())):
        places = {}
        for (h, _), x in paths.items():
            if len(x["s"]) > level:
                places.setdefault((h, x["t"]), {}).setdefault(x["s"][level], []).append(x)
        for kinds in places.values():
            sums = {k: {c: sum(x[c] for x in xs) for c in ("n", "labelled", "blocked")} for k, xs in kinds.items()}
            for k, xs in kinds.items():
                sums[k]["ends"] = sum(x["n"] for x in xs if len(x["s"]) == level + 1)
                sums[k]["wild"] = sum(x["n"] for x in xs if len(x["s"]) > level + 1 and x["s"][level + 1] == "*")
            total = {c: sum(v[c] for v in sums.values()) for c in ("n", "labelled", "blocked")}
            labelled = [k for k in sums if sums[k]["labelled"]]
            variable = len(kinds) >= children and len(kinds) >= variety * total["n"]

            def agrees(k):
                if len(labelled) == 1:
                    return True
                a, rest, share = sums[k], total["labelled"] - sums[k]["labelled"], total["blocked"] / total["labelled"]  # noqa: B023
                gap = abs(a["blocked"] / a["labelled"] - (total["blocked"] - a["blocked"]) / rest)  # noqa: B023
                return gap <= z * math.sqrt(share * (1 - share) * (1 / a["labelled"] + 1 / rest))

            alike = [k for k in labelled if agrees(k)]
            g = {c: sum(sums[k][c] for k in alike) for c in ("n", "ends", "wild")}

            def joins(k):
                a, mean = sums[k], g["n"] / len(alike)  # noqa: B023
                if a["labelled"] or abs(a["n"] - mean) > z * math.sqrt(mean + mean / len(alike)):  # noqa: B023
                    return False
                pooled = {c: (a[c] + g[c]) / (a["n"] + g["n"]) for c in ("ends", "wild")}  # noqa: B023
                return all(abs(a[c] / a["n"] - g[c] / g["n"]) <= z * math.sqrt(p * (1 - p) * (1 / a["n"] + 1 / g["n"])) for c, p in pooled.items())  # noqa: B023

            new = [k for k in kinds if alike and joins(k)]
            wild = set(kinds) if variable else {*new, *(alike if len(labelled) > 1 or new else [])}
            for k, xs in kinds.items():
                for x in xs:
                    x["t"] += "/" + ("*" if k in wild else k)
    prior = sum(x["blocked"] for x in paths.values()) / max(1, sum(x["labelled"] for x in paths.values()))
    stats = {}
    for (h, _), x in paths.items():
        v = stats.setdefault((h, x["t"]), [0, 0])
        v[0] += x["blocked"]
        v[1] += x["labelled"]
    out = []
    for h, p, rule, said in pages:
        b, n = stats[h, t := paths[h, p]["t"]]
        tree = "block" if n and (b + weight * prior) / (n + weight) >= purity else "allow"
        out.append((rule, said or tree, t, round((b + weight * prior) / (n + weight), 6), tree))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_equals_a_naive_tree(spark, seed):
    rnd = random.Random(seed)
    rules = (("a.org/es/", "block"), ("a.org/fr/", "block"), ("a.org/news/1", "allow"), ("b.org/x", "block"), ("b.org/xy", "allow"), ("c.org/", "block"))
    words = ["es", "fr", "de", "it", "news", "x", "xy", "y", "deadbeef01", "item"]

    def url():
        path = [rnd.choice([*words, str(rnd.randrange(100)), f"{rnd.randrange(9)}.html", f"w{rnd.randrange(40)}"]) for _ in range(rnd.choice([0, 1, 2, 2, 3, 3, 6]))]
        return f"http://{rnd.choice('abc')}.org/{'/'.join(path)}"

    urls = [url() for _ in range(500)] + [f"http://a.org/{b}/{k}" for b in ("es", "fr", "de", "it") for k in range(20)] + URLS
    urls += ["http://deep.org/" + "/".join("abcdefghij")] * 2 + ["http://deep.org/" + "/".join("abcdefghij") + "/k", "http://long.org/" + "s/" * 3000]
    urls += rnd.choices(urls, k=100)
    got = sorted(judge(frame(spark, urls), rules=rules).collect(), key=lambda r: r["page_id"])
    want = naive(urls, rules)
    assert [(r["rule"], r["verdict"], r["template"], r["template_purity"], r["tree_verdict"]) for r in got] == [(a, b, c, pytest.approx(d, abs=2e-6), e) for a, b, c, d, e in want]
    assert any(w[0] is None and w[1] == "block" for w in want)


def test_labels_may_be_kept_from_the_tree(spark):
    urls = [f"http://shop.net/es/{k}" for k in range(50)]
    pages = frame(spark, urls)
    assert {r["tree_verdict"] for r in judge(pages, teaches=F.col("path").rlike("[02468]$")).collect()} == {"block"}
    assert {r["tree_verdict"] for r in judge(pages, teaches=F.lit(False)).collect()} == {"allow"}


def test_an_id_named_like_a_result(spark):
    got = judge(spark.createDataFrame([("http://a.b/c", 1)], "u string, host int"), id_col="host", url_col="u")
    assert got.columns[:2] == ["host", "host_"] and got.first()["host"] == 1 and got.first()["host_"] == "a.b"


def test_empty(spark):
    assert judge(frame(spark, [])).count() == 0
