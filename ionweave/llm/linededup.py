"""Line dedup by overlapping windows of three lines, with DataFrame functions only.

Lines are compared without the white space around them; blank lines are skipped, and belong to no window. A window's 128-bit hash
is counted over all documents. Of a window that occurs more than once, the occurrence with the smallest (id, text's hash, position)
stays; the lines of all the others are covered, and covered lines go. Windows overlap, so a longer repeated passage is covered as a whole.

The only group is a hash's: counting combines before the shuffle, and the occurrences meet the repeated hashes in a join that
Spark splits where a window is very common. No document's lines or texts travel but to be rejoined with its covered positions.

Edge cases: a null text counts as empty; it has no lines to remove and stays null. A document with fewer than three lines with text
loses none. A row is known by its id and its text: rows that share an id but not the text lose what they repeat themselves, equal rows
lose the same lines, and where the first occurrence is theirs, it stays in each. Rows without an id take no part and keep their text.
Texts are whole, however long. Columns beyond id and text pass through ``without_repeats`` unchanged, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.common import cut, discard, fresh, table

WINDOW = 3
#: What is trimmed from a line.
BLANKS = " \t\r\x0b\x0c"


def lines_of(text: str | Column) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n")


def copy_of(text_col: str) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def windows(docs: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """(id, copy, nth, lines, h1, h2): each window of ``size`` lines with text, with the numbers of its lines."""
    trimmed = F.transform(lines_of(text_col), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(BLANKS)).alias("line")))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), copy_of(text_col).alias("copy"), trimmed.alias("x"))
    full = rows.select("id", "copy", F.filter("x", lambda x: x["line"] != "").alias("x")).filter(F.size("x") >= size)

    def window(i: Column) -> Column:
        part = [F.get(F.col("x"), i + k) for k in range(size)]
        text = [p["line"] for p in part]
        lines = F.array(*(p["at"] for p in part)).alias("lines")
        return F.struct(i.alias("nth"), lines, F.xxhash64(*text).alias("h1"), F.xxhash64(F.lit(size), *reversed(text)).alias("h2"))

    every = F.transform(F.sequence(F.lit(0), F.size("x") - size), window)
    return full.select("id", "copy", F.explode(every).alias("w")).select("id", "copy", "w.*")


def covered_lines(docs: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """(id, copy, covered): numbers of the lines that later occurrences of windows cover, for rows that have some."""
    place = F.struct("id", "copy", "nth")
    all_windows = cut(windows(docs, id_col, text_col, size), "windows")
    often = all_windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first")
    later = all_windows.join(often, ["h1", "h2"]).filter(place > F.col("first"))
    covered = cut(later.groupBy("id", "copy").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("covered")), "covered")
    discard(all_windows)
    return covered


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed", size: int = WINDOW
) -> DataFrame:
    """``docs`` with covered lines removed from its texts, and two columns more, of which the names are given."""
    key, copy, gone = fresh(docs, "_id"), fresh(docs, "_copy"), fresh(docs, "_covered")
    covered = covered_lines(docs, id_col, text_col, size).select(F.col("id").alias(key), F.col("copy").alias(copy), F.col("covered").alias(gone))
    # what is covered grows with the documents, so it is shuffled to them at any size
    met = docs.join(covered.hint("merge"), (F.col(id_col) == F.col(key)) & (copy_of(text_col) == F.col(copy)), "left")
    lines = lines_of(text_col)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    counts = [F.size(lines).cast("long").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed)]
    return met.select(*((text.alias(c) if c == text_col else F.col(c)) for c in docs.columns), *counts)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` without repeated passages; rows that lost lines and have no text left go."""
    total, removed = fresh(docs, "_lines"), fresh(docs, "_removed")
    left = without_repeats(docs, id_col, text_col, total, removed, size)
    return left.filter((F.col(removed) == 0) | (F.btrim(text_col, F.lit(BLANKS + "\n")) != "")).select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = r"""
WITH raw AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM raw),
t AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM x),
full_lines AS (SELECT doc_id, pos, line FROM t WHERE line <> ''),
w AS (SELECT doc_id, pos AS p0, lead(pos, 1) OVER d AS p1, lead(pos, 2) OVER d AS p2,
             line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS key
      FROM full_lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, p0) AS nth FROM w WHERE key IS NOT NULL) AS numbered WHERE nth > 1),
covered AS (SELECT doc_id, p0 AS pos FROM later UNION SELECT doc_id, p1 FROM later UNION SELECT doc_id, p2 FROM later),
joined AS (SELECT x.doc_id, x.pos, x.line, c.pos IS NULL AS stays FROM x LEFT JOIN covered AS c ON x.doc_id = c.doc_id AND x.pos = c.pos),
built AS (SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN stays THEN 0 ELSE 1 END) AS n_removed, string_agg(CASE WHEN stays THEN line END, chr(10) ORDER BY pos) AS kept FROM joined GROUP BY doc_id)
SELECT b.doc_id, CAST(b.n_lines AS BIGINT) AS n_lines, CAST(b.n_removed AS BIGINT) AS n_removed,
       CASE WHEN b.n_removed = 0 THEN r.text ELSE coalesce(b.kept, '') END AS text
FROM built AS b JOIN raw AS r ON b.doc_id = r.doc_id
"""
