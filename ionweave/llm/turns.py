"""Cheapest repair of conversations whose rows are damaged: which to keep, give another role, delete, and what to insert.

A conversation is sound if the initials of its roles are nothing, or an optional ``s`` and then ``ua`` once or more. Rows that are blank
or repeat an earlier one must go. The grammar has four states (nothing yet, after s, after u, after a), so a repair is a
shortest path over rows and states, and of equally cheap ones that with the ASCII-least audit counts.

1. Spark damages the rows, numbers those of a conversation and finds their faults. Numbers are counted within stretches of turns and
   then summed, repeated texts meet by digest: no task needs all rows of a conversation.
2. Numbered rows fall into segments of ``segment`` rows, dealt to tasks by hash. A task reads them in batches of whole segments; in
   each batch a recursive query of DuckDB advances one row for all segments at once and keeps the least (cost, audit) for each state
   to begin with and each state reached. Of equally cheap audits for the same rows and states none begins another, so the
   least of a segment is part of the least of the whole.
3. Neighbouring segments are joined state by state, in as many rounds as their number has binary digits; most conversations have one.
4. The audit travels in front of the conversation's rows, which stream in order through a task that hashes the repaired text.

Memory: a batch of segments in step 2, and an audit (one character a row, as the result has it) and a batch of rows in step 4. There one
task reads a whole conversation, since a hash is taken in order; it holds none of the rows before.

Edge cases: a null role or text is one space before damage, and in the string that decides on damage a null id or turn is one. Rows without
an id are one conversation. Null turns come first; equal turns are ordered by role, then by the text's MD5 digest, a repetition after
its original. An initial is the role's first character as it is, so other roles can't be kept unless they begin with s, u or a. Repeated rows
are duplicates like any others. A conversation of which damage leaves nothing has zeros, an empty audit and the hash of an empty
string. Very long texts are read whole, a batch at a time. Other columns are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionweave.llm.common import beside, cut, discard, resident, ship, table

SEGMENT = 256
#: Rows in a batch of segments.
BATCH_ROWS = 8192
#: Turns of one stretch, as a power of two.
STRETCH = 9
GAPS = " \t\n\x0b\f\r"
#: States of the grammar, by what was put out last.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = {
    (NOTHING, "s"): AFTER_S,
    (NOTHING, "u"): AFTER_U,
    (AFTER_S, "u"): AFTER_U,
    (AFTER_U, "a"): AFTER_A,
    (AFTER_A, "u"): AFTER_U,
}
_ROLE = {"u": "user", "a": "assistant"}


def insertions() -> list[tuple[int, str, int]]:
    """(state, roles' initials, state) of insertions that may be worth their cost: none that lead back to where they began."""
    out = [(q, "", q) for q in range(4)]
    for q, x in _NEXT:
        if x != "s":
            to = _NEXT[q, x]
            out.append((q, x, to))
            out += [(q, x + y, _NEXT[to, y]) for z, y in _NEXT if z == to and y != "s" and _NEXT[to, y] != q]
    return out


def moves() -> list[tuple[int, str, str, str, str, int, int]]:
    """(state, inserted initials, letters, letter, initial put out, state, cost): insertions, then one row's edit."""
    out = []
    for q, put, mid in insertions():
        base = 2 * len(put)
        out.append((q, put, "I" * len(put) + "D", "D", "", mid, base + 3))
        for (state, x), to in _NEXT.items():
            if state == mid:
                out.append((q, put, "I" * len(put) + "K", "K", x, to, base))
                if x != "s":
                    out.append((q, put, "I" * len(put) + "R", "R", x, to, base + 2))
    return out


def endings() -> dict[int, str]:
    """The letters that make what was put out sound, by state."""
    return {NOTHING: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}


def _key(conv: str) -> Column:
    """A string that tells conversations apart, rows without an id included."""
    return F.when(F.col(conv).isNull(), F.lit("")).otherwise(F.concat(F.lit("c"), F.col(conv).cast("string")))


def damaged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(cv, turn, role, text, digest, copy): the rows after damage."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.pmod(F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")), F.lit(20))
    rows = df.select(_key(conv).alias("cv"), F.col(turn).cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"), lot.alias("lot"))
    less = F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    other = F.when(F.col("lot") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.filter("lot <> 0").select("cv", "turn", other.alias("role"), less.alias("text"), "lot")
    copies = F.explode(F.expr("if(lot = 3, array(0, 1), array(0))")).alias("copy")
    return rows.select("cv", "turn", "role", "text", F.unhex(F.md5("text")).alias("digest"), copies)


def numbered(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``rows`` without texts, with the place of each in its conversation and its faults; written.

    A row's number is within a stretch of 512 turns; to that come the rows of the stretches before.
    """
    end = F.rtrim(F.col("text"), F.lit(GAPS))
    facts = rows.select(
        "cv", "turn", "role", "digest", "copy",
        F.substring("role", 1, 1).alias("init"),
        (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open_end"),
        F.coalesce(F.shiftright("turn", STRETCH), F.lit(-(2**60))).alias("stretch"),
    )
    order = [F.asc_nulls_first("turn"), "role", "digest", "copy"]
    nth = F.row_number().over(Window.partitionBy("cv", "stretch").orderBy(*order)).cast("long") - 1
    facts = cut(facts.withColumn("nth", nth), "facts")
    stretches = facts.groupBy("cv", "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = stretches.select("cv", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = facts.join(bases, ["cv", "stretch"]).withColumn("at", F.col("base") + F.col("nth")).drop("base", "nth", "stretch")
    placed = cut(placed, "placed")
    firsts = placed.groupBy("cv", "role", "digest").agg(F.min("at").alias("first"))
    out = placed.join(firsts, ["cv", "role", "digest"])
    repeated = ~F.col("blank") & (F.col("at") > F.col("first"))
    out = out.withColumn("repeated", repeated).withColumn("open_end", F.col("open_end") & ~F.col("blank") & ~repeated)
    out = cut(out.select("cv", "at", F.floor(F.col("at") / segment).alias("seg"), "turn", "init", "blank", "repeated", "open_end"), "faults")
    discard(facts, placed)
    return out


def counted(rows: DataFrame) -> DataFrame:
    """(cv, gaps, blank, duplicate, truncated, illegal, segs): counts of each conversation, by way of its segments."""
    w = Window.partitionBy("cv", "seg").orderBy("at")
    legal = lambda pair: F.coalesce(pair.isin("su", "ua", "au"), F.lit(True))
    near = rows.withColumn("pair", F.concat(F.lag("init").over(w), F.col("init"))).withColumn("last", F.lag("turn").over(w))
    fresh = F.col("turn").isNotNull() & (F.col("last").isNull() | (F.col("last") != F.col("turn")))
    count = lambda c: F.count_if(c)
    segs = near.groupBy("cv", "seg").agg(
        count("blank").alias("blank"), count("repeated").alias("duplicate"), count("open_end").alias("truncated"),
        count(~legal(F.col("pair"))).alias("illegal"), count(fresh).alias("fresh"), F.min("turn").alias("low"), F.max("turn").alias("high"),
        F.min_by("init", "at").alias("i0"), F.max_by("init", "at").alias("i1"), F.min_by("turn", "at").alias("t0"), F.max_by("turn", "at").alias("t1"),
    )
    by_seg = Window.partitionBy("cv").orderBy("seg")
    segs = segs.withColumn("pair", F.concat(F.lag("i1").over(by_seg), F.col("i0"))).withColumn("same", F.lag("t1").over(by_seg) == F.col("t0"))
    total = segs.groupBy("cv").agg(
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        (F.sum("illegal") + count(~legal(F.col("pair")))).alias("illegal"),
        F.coalesce(F.max("high") - F.min("low") + 1 - (F.sum("fresh") - count(F.coalesce("same", F.lit(False)))), F.lit(0)).alias("gaps"),
        (F.max("seg") + 1).alias("segs"),
    )
    return total


WALK = """
WITH RECURSIVE walk AS (
  SELECT seg, start, start AS q, 0 AS nth, 0::BIGINT AS cost, '' AS audit FROM starts
  UNION ALL
  SELECT seg, start, q, nth, least.cost, least.audit FROM (
    SELECT w.seg, w.start, m.dest AS q, w.nth + 1 AS nth, min({'cost': w.cost + m.cost + CASE WHEN t.open_end AND m.letter <> 'D' THEN 1 ELSE 0 END, 'audit': w.audit || m.letters}) AS least
    FROM walk AS w JOIN turns AS t ON t.seg = w.seg AND t.nth = w.nth
    JOIN moves AS m ON m.q = w.q AND (m.letter = 'D' OR NOT t.must_go) AND (m.letter <> 'K' OR m.init = t.init)
    GROUP BY w.seg, w.start, m.dest, w.nth))
SELECT w.seg, w.start, w.q, w.cost, w.audit FROM walk AS w JOIN starts AS s ON s.seg = w.seg AND s.start = w.start AND s.n = w.nth
"""


def _database():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.register("moves", _moves_table())
    return con


def _moves_table() -> pa.Table:
    rows = [(q, letters, letter, init, dest, cost) for q, _, letters, letter, init, dest, cost in moves()]
    return pa.table(dict(zip(["q", "letters", "letter", "init", "dest", "cost"], map(list, zip(*rows, strict=True)), strict=True)))


def paths(rows: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(cv, seg, start, q, cost, audit): the least repair of each segment from each state to each state. The first segment
    of a conversation begins with nothing; others begin with any state."""

    def walked(batch: pa.Table) -> pa.RecordBatch:
        con = resident("turns", _database)
        cv, seg = batch.column("cv").to_pylist(), batch.column("seg").to_pylist()
        names = list(zip(cv, seg, strict=True))
        ids, nth, own = [], [], {}
        for name in names:
            k, n = own.get(name, (len(own), 0))
            own[name] = (k, n + 1)
            ids.append(k)
            nth.append(n)
        starts = [(k, q, n) for (_, s), (k, n) in own.items() for q in range(4 if s else 1)]
        con.register("turns", pa.table({"seg": ids, "nth": nth, "init": batch.column("init"), "must_go": batch.column("must_go"), "open_end": batch.column("open_end")}))
        con.register("starts", pa.table(dict(zip(["seg", "start", "n"], map(list, zip(*starts, strict=True)), strict=True))))
        got = con.execute(WALK).fetchall()
        con.unregister("turns")
        con.unregister("starts")
        by_id = list(own)
        out = [(*by_id[k], *rest) for k, *rest in got]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["cv", "seg", "start", "q", "cost", "audit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            if sum(map(len, held)) < batch_rows:
                continue
            # all but the segment that may go on in the next batch
            rows = pa.concat_tables(held)
            cv, seg = rows.column("cv").to_pylist(), rows.column("seg").to_pylist()
            cut_at = len(rows)
            while cut_at and (cv[cut_at - 1], seg[cut_at - 1]) == (cv[-1], seg[-1]):
                cut_at -= 1
            if cut_at:
                yield walked(rows.slice(0, cut_at))
            held = [rows.slice(cut_at)]
        if held:
            yield walked(pa.concat_tables(held))

    narrow = rows.select("cv", "seg", "at", "init", (F.col("blank") | F.col("repeated")).alias("must_go"), "open_end")
    dealt = narrow.repartition("cv", "seg").sortWithinPartitions("cv", "seg", "at")
    return dealt.mapInArrow(run, "cv string, seg long, start int, q int, cost long, audit string")


def joined(found: DataFrame, segs: DataFrame) -> DataFrame:
    """(cv, cost, audit) of whole conversations from the paths of their segments; written."""
    few = cut(segs.filter("segs > 1").select(F.col("cv").alias("_cv"), "segs"), "long")
    most = few.agg(F.max("segs")).first()[0] or 1
    one = found.join(few, F.col("cv") == F.col("_cv"), "left_anti")
    many = found.join(few, F.col("cv") == F.col("_cv"), "left_semi")
    while most > 1:
        side = lambda odd, p: many.filter(F.col("seg") % 2 == odd).select(*(F.col(c).alias(p + c) for c in many.columns))  # noqa: B023, E731
        pairs = side(0, "a_").join(side(1, "b_"), F.expr("a_cv = b_cv and a_seg + 1 = b_seg and a_q = b_start"))
        least = pairs.groupBy(F.col("a_cv").alias("cv"), F.floor(F.col("a_seg") / 2).alias("seg"), F.col("a_start").alias("start"), F.col("b_q").alias("q"))
        least = least.agg(F.min(F.struct((F.col("a_cost") + F.col("b_cost")).alias("cost"), F.concat("a_audit", "b_audit").alias("audit"))).alias("x"))
        # the last of an odd number has no partner
        lone = many.withColumn("n", F.max("seg").over(Window.partitionBy("cv"))).filter("seg = n and seg % 2 = 0").withColumn("seg", F.floor(F.col("seg") / 2)).drop("n")
        before, many = many, cut(least.select("cv", "seg", "start", "q", "x.cost", "x.audit").unionByName(lone), "joined")
        discard(before)
        most = -(-most // 2)
    ends = F.create_map(*(F.lit(x) for pair in endings().items() for x in pair))[F.col("q")]
    whole = one.unionByName(many).select("cv", (F.col("cost") + 2 * F.length(ends)).alias("cost"), F.concat("audit", ends).alias("audit"))
    out = whole.groupBy("cv").agg(F.min(F.struct("cost", "audit")).alias("x")).select("cv", "x.cost", "x.audit")
    out = cut(out, "audits")
    discard(few, many)
    return out


class Repaired:
    """The hash of a conversation as its audit repairs it, taken row by row."""

    def __init__(self, audit: str):
        self.letters, self.at, self.q, self.lines = audit, 0, NOTHING, 0
        self.hash = hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _insert(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            self._put(self._due(), "")

    def _due(self) -> str:
        """The role that the grammar asks for."""
        x = "a" if self.q == AFTER_U else "u"
        self.q = _NEXT[self.q, x]
        return _ROLE[x]

    def row(self, role: str, text: str) -> None:
        self._insert()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            self._put(self._due(), text)
        elif letter == "K":
            self.q = _NEXT[self.q, role[:1]]
            self._put(role, text)

    def digest(self) -> str:
        self._insert()
        if self.at != len(self.letters):
            raise ValueError("an audit has more edits than its conversation has rows")
        return self.hash.hexdigest()


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired(rows: DataFrame, heads: DataFrame, conv_type: str) -> DataFrame:
    """``heads`` (cv, conv, counts, audit) with the hash of each conversation. A head comes before its rows, which stream by."""
    kept = ["conv", *_COUNTS, "audit"]
    schema = ", ".join([f"conv {conv_type}", *(f"{c} long" for c in _COUNTS), "audit string", "repaired_sha256 string"])
    target = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("turns-hash")
        head, now = None, None
        for b in batches:
            done, hashes = [], []
            order = b.column("part").to_pylist()
            role, text, audit = (b.column(c).to_pylist() for c in ("role", "text", "audit"))
            for k, part in enumerate(order):
                if part:
                    now.row(role[k], text[k])
                    continue
                if now is not None:
                    done.append(head)
                    hashes.append(now.digest())
                head, now = b.select(kept).slice(k, 1), Repaired(audit[k])
            if done:
                yield _told(done, hashes)
        if now is not None:
            yield _told([head], [now.digest()])

    texts = rows.select("cv", F.lit(1).alias("part"), "turn", "role", "digest", "copy", "text")
    both = heads.select("cv", F.lit(0).alias("part"), *kept).unionByName(texts, allowMissingColumns=True)
    dealt = both.repartition("cv").sortWithinPartitions("cv", "part", F.asc_nulls_first("turn"), "role", "digest", "copy")
    return dealt.select("part", "role", "text", *kept).mapInArrow(run, target)


def _told(heads: list[pa.RecordBatch], hashes: list[str]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(heads).combine_chunks().append_column("repaired_sha256", pa.array(hashes, pa.string()))
    return rows.to_batches()[0]


def repair(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment: int = SEGMENT,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``df``, damaged."""
    ship(df.sparkSession)
    rows = damaged(df, conv_col, turn_col, role_col, text_col)
    facts = numbered(rows, segment)
    counts = cut(counted(facts), "counts")
    audits = joined(cut(paths(facts, batch_rows), "paths"), counts)
    every = df.select(_key(conv_col).alias("cv"), F.col(conv_col).alias("conv")).distinct()
    heads = every.join(counts, "cv", "left").join(audits, "cv", "left")
    none = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS]
    heads = heads.select("cv", "conv", *none, F.coalesce("audit", F.lit("")).alias("audit"))
    names = beside(conv_col, [*_COUNTS, "audit", "repaired_sha256"])
    return repaired(rows, heads, df.schema[conv_col].dataType.simpleString()).toDF(conv_col, *names)


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def _moves_sql() -> str:
    line = "".join
    rows = (f"({q}, '{line(f'{chr(10)}{_ROLE[x]}:' for x in put)}', '{letters}', '{letter}', '{init}', {dest}, {cost})" for q, put, letters, letter, init, dest, cost in moves())
    return ", ".join(rows)


ORACLE = f"""
WITH RECURSIVE step AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS s FROM conversations),
lots AS (SELECT told.*, xor(list_reduce(s, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS lot FROM told, step),
hurt AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy FROM lots WHERE lot <> 0),
nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) - 1 AS nth, left(role, 1) AS init, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
seen AS (SELECT *, body = '' AS blank, nth > min(nth) OVER (PARTITION BY conv_id, role, text) AS again, right(body, 1) NOT IN ('.', '!', '?') AS open_end,
         lag(init) OVER (PARTITION BY conv_id ORDER BY nth) || init AS pair FROM nth),
turns AS (SELECT *, blank OR again AS must_go, open_end AND NOT blank AND NOT again AS trunc FROM seen),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
           count(*) FILTER (trunc) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM turns GROUP BY conv_id),
moves(q, put, letters, letter, init, dest, cost) AS (VALUES {_moves_sql()}),
walk AS (SELECT conv_id, 0 AS q, 0 AS nth, 0::BIGINT AS cost, '' AS audit, '' AS body FROM counts
  UNION ALL
  SELECT conv_id, q, nth, least.cost, least.audit, least.body FROM (
    SELECT w.conv_id, m.dest AS q, w.nth + 1 AS nth, min({{'cost': w.cost + m.cost + CASE WHEN t.trunc AND m.letter <> 'D' THEN 1 ELSE 0 END, 'audit': w.audit || m.letters,
      'body': w.body || m.put || CASE m.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || t.role || ':' || t.text ELSE chr(10) || CASE m.init WHEN 'u' THEN 'user:' ELSE 'assistant:' END || t.text END}}) AS least
    FROM walk AS w JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.nth = w.nth
    JOIN moves AS m ON m.q = w.q AND (m.letter = 'D' OR NOT t.must_go) AND (m.letter <> 'K' OR m.init = t.init)
    GROUP BY w.conv_id, m.dest, w.nth)),
ended AS (SELECT w.conv_id, min({{'cost': w.cost + 2 * len(e.letters), 'audit': w.audit || e.letters, 'body': w.body || e.body}}) AS x FROM walk AS w
          JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.nth
          JOIN (VALUES (0, '', ''), (1, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 'I', chr(10) || 'assistant:'), (3, '', '')) AS e(q, letters, body) ON e.q = w.q GROUP BY w.conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(e.x.cost, 0) AS cost, coalesce(e.x.audit, '') AS audit, sha256(substr(coalesce(e.x.body, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended AS e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
