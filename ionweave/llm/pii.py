"""Personal data by patterns, and terms that give protected entities away, with DataFrame functions only.

Base spans are emails, IP addresses, card and phone numbers. The method adds terms: every value found is a protected entity c with
information content IC(c) = -log2 p(c), p(c) being its share of all documents. A term t of a document that holds c, however far
from it, discloses PMI(c; t) = log2(p(c | t) / p(c)) of that. In place of p(c | t) stands its lower confidence bound (Wilson's, one-sided at
80 %), so that an entity or term of few documents counts with what few documents show; there is no least number. Where PMI / IC
reaches ``generalise``, a term is generalised in the documents that hold the entity, and removed where it reaches ``remove``.
A row is a document, and all counts are of rows. Equal texts are one observation to the bound, so what stands near an entity only
because its whole document was copied discloses no more than one document does, and a table with all rows twice has the same terms;
a block repeated in different documents counts with each.

Regular expressions are possessive and anchored behind a non-member (or the end of the match before), so that each gives the
matches of its plain form in time that is linear in the text. Positions come from the pieces between matches, in code points.

Edge cases: a null or empty text has no spans, and stays null or empty. Spans belong to a text, not to an id: rows that share an id have each
their own, equal rows the same, rows without an id are like others. Texts are whole, however long. Other columns pass through
``sanitise`` unchanged, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.common import cut, discard, fresh, table

KINDS = ("email", "ip", "card", "phone", "term", "removed")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORD = r"(?<!\p{L})\p{L}++"
#: Matches whose positions are summed at a time.
RUN = 64
#: Standard deviations of the one-sided bound of 80 %.
Z = 0.8416
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: Column, kind: int) -> Column:
    """The matches of a pattern as (start, kind, end, value), left to right.

    Positions are running totals of the pieces between matches. They are summed in runs of ``RUN`` matches and then over the runs,
    as appending to one long array copies it each time.
    """
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    steps = let(gaps, lambda g: F.transform(matches, lambda x, i: F.struct(F.char_length(F.get(g, i)).alias("gap"), x.alias("value"))))
    whole, offsets = f"struct<at:int,out:{SPAN}>", "struct<at:int,out:array<int>>"
    none = lambda kind: F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))).alias("out")).cast(whole)

    def runs(all_steps: Column) -> Column:
        begins = F.when(F.size(all_steps) > 0, F.sequence(F.lit(0), F.size(all_steps) - 1, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        return F.transform(begins, lambda b: F.aggregate(F.slice(all_steps, b + 1, RUN), none(SPAN), step))

    def placed(some: Column) -> Column:
        totals = F.aggregate(some, none("array<int>"), lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast(offsets), lambda acc: acc["out"])

        def moved(s: Column, by: Column) -> Column:
            return F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value"))

        return let(totals, lambda t: F.flatten(F.transform(some, lambda x, i: F.transform(x["out"], lambda s: moved(s, F.get(t, i))))))

    return let(let(steps, runs), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    d = F.reverse(digits(value))

    def worth(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = 2 * x
        return F.when(i % 2 == 1, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind. Texts without the signs that a kind needs aren't searched for it."""
    none = F.array().cast(SPAN)
    n_digits = lambda x: F.char_length(digits(x["value"]))
    number = text.rlike("[0-9]")
    email = F.when(F.contains(text, F.lit("@")), found(text, F.lit(EMAIL), 0)).otherwise(none)
    ip = F.when(number, F.filter(found(text, F.lit(IP), 1), lambda x: x["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))).otherwise(none)
    card = F.when(number, F.filter(F.filter(found(text, F.lit(CARD), 2), lambda x: n_digits(x).between(12, 19)), lambda x: luhn(x["value"]))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(found(text, F.lit(PHONE), 3), lambda x: n_digits(x).between(9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def marked(rows: DataFrame, text_col: str, spans: str, copy: str) -> DataFrame:
    """``rows`` with their base spans and, where there are some, 128 bits of the text's hash."""
    found = rows.withColumn(spans, base_spans(F.coalesce(F.col(text_col), F.lit(""))))
    return found.withColumn(copy, F.when(F.size(spans) > 0, F.unhex(F.substring(F.sha2(text_col, 256), 1, 32))))


def holders(base: DataFrame) -> DataFrame:
    """(copy, rows, entities, words) of texts with values, from rows (copy, spans, text): the values, and all distinct
    words of the whole text but those within emails."""
    names = F.array(*map(F.lit, KINDS))
    texts = base.filter("copy IS NOT NULL").groupBy("copy").agg(F.count("*").alias("rows"), F.first("spans").alias("spans"), F.first("text").alias("text"))
    entities = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), F.lower(s["value"]))))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace("text", EMAIL, " ")), F.lit(WORD), F.lit(0)))
    return texts.select("copy", "rows", entities.alias("entities"), words.alias("words"))


def bound(p: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share p of n observations."""
    return F.try_divide(p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n)


def disclosing(texts: DataFrame, base: DataFrame, generalise: float, remove: float, z: float) -> DataFrame:
    """(copy, terms): for each text, its terms that disclose at least ``generalise`` of the information content of an entity in it.
    ``texts`` has the column ``text`` of all rows; ``base`` the rows (copy, spans, text).

    Words are counted with partial aggregation. As p(c | t) is at most n_c / n_t, a term of more than N^(1 - g) n_c^g documents can't
    disclose g of c; such pairs are left out before they are counted, which changes no result.
    """
    held = cut(holders(base), "holders")
    n_docs = texts.count()
    entities = held.select("copy", "rows", F.explode("entities").alias("entity"))
    n_c = cut(entities.groupBy("entity").agg(F.sum("rows").alias("n_c")), "entities")
    most = n_c.agg(F.max("n_c")).first()[0] or 0
    limit = lambda c: 1.000001 * F.pow(F.lit(float(n_docs)), F.lit(1 - generalise)) * F.pow(c, F.lit(generalise))
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(WORD), F.lit(0)))).alias("term"))
    # the filter on a count keeps the join below from moving under the counting, where it meets every word
    counts = words.groupBy("term").agg(F.count("*").alias("n_t")).filter(F.col("n_t") <= limit(F.lit(float(most))))
    terms = held.select("copy", F.explode("words").alias("term")).join(counts, "term")
    pairs = cut(entities.join(n_c, "entity").join(terms, "copy").filter(F.col("n_t") <= limit(F.col("n_c"))), "pairs")
    discard(held, n_c)
    both = pairs.groupBy("entity", "term", "n_c", "n_t").agg(F.sum("rows").alias("held"), F.count("*").alias("texts"))
    p_c = F.col("n_c") / F.lit(max(1, n_docs))
    p = F.least(F.lit(1.0), F.try_divide("held", "n_t"))
    disclosed = F.try_divide(F.log2(bound(p, F.col("n_t") * F.col("texts") / F.col("held"), z) / p_c), -F.log2(p_c))
    found_out = both.filter(p_c < 1).select("entity", "term", disclosed.alias("disclosed")).filter(F.col("disclosed") >= generalise)
    by_text = pairs.join(found_out, ["entity", "term"]).groupBy("copy", "term").agg((F.max("disclosed") >= remove).alias("hard"))
    out = cut(by_text.groupBy("copy").agg(F.collect_list(F.struct("term", "hard")).alias("terms")), "terms")
    discard(pairs)
    return out


def term_spans(text: Column, terms: Column, spans: Column) -> Column:
    """The spans of a text's terms (term, hard) that overlap no base span."""

    def of(hard: bool, kind: int) -> Column:
        some = F.array_sort(F.transform(F.filter(terms, lambda t: t["hard"] == hard), lambda t: t["term"]))
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(some, "|"), F.lit(r")(?!\p{L})"))
        free = F.filter(found(text, pattern, kind), lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
        return F.when(F.size(some) > 0, free).otherwise(F.array().cast(SPAN))

    return F.when(terms.isNotNull() & text.isNotNull(), F.concat(of(False, 4), of(True, 5))).otherwise(F.array().cast(SPAN))


def with_terms(base: DataFrame, terms: DataFrame, copy: str, name: str) -> DataFrame:
    """``base`` with the terms of each row's text. Rows without values have none and take no part in the join."""
    key = fresh(base, "_copy")
    side = terms.select(F.col("copy").alias(key), F.col("terms").alias(name))
    met = base.filter(F.col(copy).isNotNull()).join(side, F.col(copy) == F.col(key), "left").drop(key)
    return met.unionByName(base.filter(F.col(copy).isNull()).withColumn(name, F.lit(None).cast(side.schema[name].dataType)))


def all_spans(docs: DataFrame, id_col: str, text_col: str, generalise: float = 0.9, remove: float = 0.97, z: float = Z) -> DataFrame:
    """(id, spans, more): base spans and term spans of every row. The texts are written only where there are spans."""
    rows = marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "spans", "copy")
    base = cut(rows.select("id", "spans", "copy", F.when(F.col("copy").isNotNull(), F.col("text")).alias("text")), "base")
    terms = disclosing(docs.select(F.col(text_col).alias("text")), base, generalise, remove, z)
    met = with_terms(base, terms, "copy", "terms")
    return met.select("id", "spans", term_spans(F.col("text"), F.col("terms"), F.col("spans")).alias("more"))


def mark_of(span: Column) -> Column:
    """What stands for a span: its kind, for a generalised term the class of its form, for a removed one nothing."""
    value = span["value"]
    form = F.when(value.rlike(r"^\p{Lu}{2,}$"), "[ACRONYM]").when(value.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    marks = F.array(*(F.lit(m) for m in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "")))
    return F.when(span["kind"] == KINDS.index("term"), form).otherwise(F.get(marks, span["kind"]))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its mark; spans that overlap are replaced as one."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark_of(s))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = 0.9, remove: float = 0.97, z: float = Z
) -> DataFrame:
    """``docs`` with base spans and disclosing terms replaced in its texts; columns and rows stay. ``id_col`` is not read."""
    spans, copy, own = (fresh(docs, c) for c in ("_spans", "_copy", "_terms"))
    base = cut(marked(docs, text_col, spans, copy), "base")
    texts = base.select(F.col(text_col).alias("text"))
    terms = disclosing(texts, base.select(F.col(copy).alias("copy"), F.col(spans).alias("spans"), F.col(text_col).alias("text")), generalise, remove, z)
    met = with_terms(base, terms, copy, own)
    every = F.array_sort(F.concat(spans, term_spans(F.col(text_col), F.col(own), F.col(spans))))
    text = F.when(F.size(every) > 0, redacted(F.col(text_col), every)).otherwise(F.col(text_col))
    return met.select(*((text.alias(c) if c == text_col else F.col(c)) for c in docs.columns))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = all_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")

    def n(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = map(n, range(4))
    return spans.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("spans", "more"))).alias("spans"))
