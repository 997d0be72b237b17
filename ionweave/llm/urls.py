"""URL filter: suffix rules, then a path-template tree per host whose templates are rejected by smoothed labelled purity.

A rule is a host and the beginning of a path; it fits its host and all subdomains, and of the rules that fit, the longest decides.
Pages that a rule decides are the labelled ones. Over all pages, each host has a tree of its path segments, level by level:

* a segment that is a number (with or without an ending) or a hexadecimal name is a wildcard; so are all segments at a place where they are mostly different;
* of the branches at one place, labelled ones whose share of blocked pages does not differ from that of all labelled branches there by
  more than chance (a two-proportion test) merge into the wildcard; a single labelled branch stands for itself;
* a branch without labels merges with these if it is built like them: neither its number of pages nor the shares of its pages that end
  there, or go on with a wildcard, differ from theirs by more than chance.

A template is a page's path with these replacements, whatever its depth. It is rejected if its labelled purity, smoothed by
the corpus' share of blocked pages, reaches ``purity``; pages without a rule get its verdict. Templates without labels are allowed
outright, whatever the corpus' share that they show as purity, so nothing is rejected without evidence.

Only distinct (host, path) pairs go through the tree; every count combines before its shuffle, and a hot host or path is a
few rows after that. A path leaves the tree at its end, or where no other path is left beside it: below, nothing can merge with it.
So there are as many rounds as levels on which two paths share a template. Pages meet their path's template in a join that Spark
splits where one is hot.

Edge cases: a url that is null or has no ``://`` has an empty host and path, and is judged by the template of that. Urls of any length
are read whole. Equal rows are judged alike; null ids stay null. Other columns are neither read nor returned; a result's column that
has the id's name gets an underscore. An empty table gives no rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.common import beside, cut, discard, table

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    after = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.char_length(host) + 1, F.char_length(after)), "^[^?#]*", 0)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def rule_and_verdict(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; null if none does. Of rules of one length the first by text counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        own, _, begin = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + begin))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    """A segment, or the wildcard for numbers and hexadecimal names."""
    return F.when(segment.rlike("^[0-9]+(\\.[A-Za-z0-9]+)?$") | (segment.rlike("^[0-9a-fA-F-]{8,}$") & segment.rlike("[0-9]")), F.lit("*")).otherwise(segment)


PLACE = ["host", "t"]


def nodes_of(paths: DataFrame, level: int) -> DataFrame:
    """(host, t, seg, n, labelled, blocked, rows, ends, wild): the branches at each place, with the pages under them, how many of
    these end there, and how many go on with a wildcard."""
    after = F.get("s", F.lit(level + 1))
    ends, wild = F.when(after.isNull(), F.col("n")).otherwise(0), F.when(after == "*", F.col("n")).otherwise(0)
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    return paths.groupBy(*PLACE, "seg").agg(*sums, F.count("*").alias("rows"), F.sum(ends).alias("ends"), F.sum(wild).alias("wild"))


def turned(nodes: DataFrame, children: int, variety: float, z: float) -> DataFrame:
    """(host, t, seg, to, lone): what each branch is called in templates, and whether it is the only path at its place."""
    here = {f"all_{c}": F.sum(c) for c in ("n", "labelled", "blocked", "rows")}
    here |= {"kinds": F.count("*"), "labelled_kinds": F.count_if(F.col("labelled") > 0)}
    met = nodes.join(nodes.groupBy(*PLACE).agg(*(c.alias(k) for k, c in here.items())), PLACE)
    variable = (F.col("kinds") >= children) & (F.col("kinds") >= variety * F.col("all_n"))
    share, rest = F.try_divide("all_blocked", "all_labelled"), F.col("all_labelled") - F.col("labelled")
    gap = F.abs(F.try_divide("blocked", "labelled") - F.try_divide(F.col("all_blocked") - F.col("blocked"), rest))
    one = F.lit(1.0)
    chance = F.sqrt(share * (1 - share) * (F.try_divide(one, F.col("labelled")) + F.try_divide(one, rest)))
    alike = (F.col("labelled") > 0) & ((F.col("labelled_kinds") == 1) | F.coalesce(gap <= z * chance, F.lit(False)))
    met = met.withColumn("variable", variable).withColumn("alike", alike)

    # of a place's branches that agree on their labels: how many, and how they are built
    agreed = met.filter("alike").groupBy(F.col("host").alias("_h"), F.col("t").alias("_t"))
    agreed = agreed.agg(F.count("*").alias("g"), *(F.sum(c).alias(f"g_{c}") for c in ("n", "ends", "wild")))
    there = (F.col("host") == F.col("_h")) & (F.col("t") == F.col("_t"))
    met = met.join(agreed, there, "left").drop("_h", "_t")
    mean = F.col("g_n") / F.col("g")
    joins = (F.col("labelled") == 0) & (F.abs(F.col("n") - mean) <= z * F.sqrt(mean + mean / F.col("g")))
    for c in ("ends", "wild"):
        pooled = (F.col(c) + F.col(f"g_{c}")) / (F.col("n") + F.col("g_n"))
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.col("g_n")))
        joins = joins & (F.abs(F.col(c) / F.col("n") - F.col(f"g_{c}") / F.col("g_n")) <= z * spread)
    met = met.withColumn("joins", F.coalesce(joins, F.lit(False)))
    # a single labelled branch becomes the wildcard only where another joins it
    company = met.filter("joins").select(F.col("host").alias("_h"), F.col("t").alias("_t")).distinct().withColumn("joined", F.lit(True))
    met = met.join(company, there, "left").drop("_h", "_t")
    several = (F.col("labelled_kinds") > 1) | F.coalesce("joined", F.lit(False))
    merged = F.col("variable") | F.col("joins") | (F.col("alike") & several)
    return met.select(*PLACE, "seg", F.when(merged, "*").otherwise(F.col("seg")).alias("to"), (F.col("all_rows") == 1).alias("lone"))


def templates_of(paths: DataFrame, children: int, variety: float, z: float) -> DataFrame:
    """(host, path, n, labelled, blocked, t): the template of each path, from rows with their segments ``s``."""
    columns = ["host", "path", "n", "labelled", "blocked", "t"]
    left = cut(paths.withColumn("t", F.lit("")), "paths")
    done, level = [left.filter(F.size("s") == 0).select(*columns)], 0
    left = left.filter(F.size("s") > 0)
    while not left.isEmpty():
        here = left.withColumn("seg", F.get("s", F.lit(level)))
        # written, as both sides of the join below read the paths
        named = cut(turned(nodes_of(here, level), children, variety, z), "turned")
        below = F.array_join(F.slice("s", level + 1, F.size("s")), "/")
        t = F.concat("t", F.lit("/"), F.when(F.col("lone"), below).otherwise(F.col("to")))
        step = here.join(named, [*PLACE, "seg"]).withColumn("t", t)
        step = cut(step.withColumn("ended", F.col("lone") | (F.size("s") == level + 1)).select(*columns, "s", "ended"), "paths")
        discard(named)
        done.append(step.filter("ended").select(*columns))
        left, level = step.filter("not ended").drop("ended"), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    children: int = 12,
    variety: float = 0.5,
    z: float = 1.96,
    weight: float = 4.0,
    purity: float = 0.8,
    teaches=None,
) -> DataFrame:
    """(id, host, path, rule, verdict, template, template_purity, tree_verdict) of each page. ``teaches`` is a condition on the
    columns ``host`` and ``path``: the tree takes labels only from pages that meet it, so that others can show how well it does."""
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    parsed = cut(parsed.select("id", "host", "path", rule.alias("rule"), verdict.alias("said")), "parsed")

    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    said = F.col("said") if teaches is None else F.when(teaches, F.col("said"))
    paths = parsed.groupBy("host", "path").agg(F.count("*").alias("n"), F.count(said).alias("labelled"), F.count_if(said == "block").alias("blocked"))
    paths = cut(templates_of(paths.withColumn("s", F.transform(segments, shape)), children, variety, z), "paths")
    corpus = paths.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    prior = F.lit((corpus["b"] or 0) / (corpus["l"] or 1))
    stats = paths.groupBy(F.col("host").alias("_h"), F.col("t").alias("_t")).agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    smoothed = (F.col("b") + weight * prior) / (F.col("l") + weight)
    rejected = (F.col("l") > 0) & (smoothed >= purity)
    stats = stats.select("_h", "_t", smoothed.alias("template_purity"), F.when(rejected, "block").otherwise("allow").alias("tree_verdict"))
    named = paths.join(stats, (F.col("host") == F.col("_h")) & (F.col("t") == F.col("_t")))
    named = cut(named.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("t").alias("template"), "template_purity", "tree_verdict"), "templates")
    discard(paths)
    met = parsed.join(named, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    judged = F.coalesce("said", "tree_verdict").alias("verdict")
    out = met.select("id", "host", "path", "rule", judged, "template", F.round("template_purity", 6).alias("template_purity"), "tree_verdict")
    return out.toDF(id_col, *beside(id_col, out.columns[1:]))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
