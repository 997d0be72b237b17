"""Codes of vectors by product quantisation, with Elkan's form of Lloyd's rounds on integers.

A vector's components become integers, the vector is cut into parts, and each part gets the index of its codebook's nearest entry. A round
assigns all parts, then moves each entry to the floor of the mean of its parts.

Between rounds a table keeps, for each part of each vector, its entry, an upper bound of the distance to it, and a lower bound of the
distance to every entry of the codebook. When entries have moved, bounds are shifted by how far. An entry is passed over only where it is
strictly farther than the upper bound, by its lower bound or by half its distance to the part's own entry (triangle inequality);
all others are worked out in integers, and of equal squared distances the lowest index wins. Bounds are rounded to the safe side (upper ones as
float32, lower ones as float16), so they decide what is worked out and never what comes out.

The codebooks are entries x components, whatever the rows; only they travel to the driver and back. A task adds up its parts before
anything is shuffled, so a codebook entry that holds a third of all parts is one row a task.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped, and so are those whose squares sum to 2^58 or more,
whose errors might be no longs. A vector that is shorter than others, or empty, counts as followed by zeros, and so does one whose
length is no multiple of the parts. The first codebook is of rows in order of id, then of vector: rows that repeat an id count each, those
without an id come last. With fewer rows than entries there are as many entries as rows. Equal vectors have equal codes. Null labels
are one label. Other columns are neither read nor returned. An empty table, or one without a sound vector, gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.common import beside, cut, discard, resident, ship, table

#: A vector takes part if the squares of its components sum to less: no squared distance is beyond a long then.
LARGEST = 2.0**58
#: What bounds are widened by: far more than square roots and differences of doubles are off.
UP, DOWN = 1 + 1e-9, 1 - 1e-9
_MOST = np.iinfo(np.int64).max
_STATE = "code binary, upper binary, lower binary, error long"


def sound_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v) with v an array of longs floor(scale * x); only rows that take part."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(vec_col).isNotNull() & finite)
    whole = F.transform(v, lambda x: F.floor(x * float(scale)).cast("double"))
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("x"))
    rows = rows.filter(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x) < LARGEST)
    return rows.select("id", "label", F.transform("x", lambda x: x.cast("long")).alias("v"))


def parted(vectors: pa.Array, parts: int, width: int) -> np.ndarray:
    """Vectors as an array (rows, parts, width), with zeros after the shorter ones."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), parts * width), dtype=np.int64)
    out[np.arange(parts * width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out.reshape(len(lengths), parts, width)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances over the last axis, in integers."""
    d = a - b
    return (d * d).sum(axis=-1)


def rounded_down(x: np.ndarray) -> np.ndarray:
    """As float16, nowhere above."""
    x = np.minimum(x, 65504.0)
    near = x.astype(np.float16)
    return np.where(near.astype(np.float64) > x, np.nextafter(near, np.float16(-np.inf)), near)


def rounded_up(x: np.ndarray) -> np.ndarray:
    """As float32, nowhere below."""
    near = x.astype(np.float32)
    return np.where(near.astype(np.float64) < x, np.nextafter(near, np.float32(np.inf)), near)


class Assigner:
    """Assigns parts to the entries of codebooks (parts, entries, width), which came from where ``before`` has them."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None = None):
        self.books = books
        apart = squares(books[:, :, None, :], books[:, None, :, :])
        self.half = np.sqrt(apart.astype(np.float64)) / 2 * DOWN
        moved = np.zeros(books.shape[:2]) if before is None else np.sqrt(squares(books, before).astype(np.float64)) * UP
        self.moved = moved
        #: Distances that were worked out.
        self.worked = 0

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is known before the first round: entry 0 for every part, and nothing of the others."""
        n, parts, _ = v.shape
        code = np.zeros((n, parts), dtype=np.uint8)
        upper = np.full((n, parts), np.inf)
        return code, upper, np.zeros((n, parts, self.books.shape[1]))

    def assign(self, v: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The new codes and bounds, and the squared distances of all parts of a vector, summed."""
        n, parts, _ = v.shape
        code, lower = code.copy(), np.maximum(lower - self.moved[None], 0.0)
        upper = (upper + np.take_along_axis(self.moved[None].repeat(n, axis=0), code[:, :, None].astype(np.int64), axis=2)[:, :, 0]) * UP
        error = np.zeros(n, dtype=np.int64)
        for p in range(parts):
            book, x, a, low = self.books[p], v[:, p], code[:, p].astype(np.int64), lower[:, p]
            own = squares(x, book[a])
            # whether any entry is left shows with the bound that was kept; then the distance itself is the bound
            rows = np.flatnonzero(self._open(p, a, upper[:, p], low).any(axis=1))
            upper[rows, p] = np.sqrt(own[rows].astype(np.float64)) * UP
            low[rows, a[rows]] = np.sqrt(own[rows].astype(np.float64)) * DOWN
            r, j = np.nonzero(self._open(p, a[rows], upper[rows, p], low[rows]))
            self.worked += len(r)
            found = squares(x[rows[r]], book[j])
            low[rows[r], j] = np.sqrt(found.astype(np.float64)) * DOWN
            all_of = np.full((len(rows), book.shape[0]), _MOST)
            all_of[np.arange(len(rows)), a[rows]] = own[rows]
            all_of[r, j] = found
            # the first of the least is the lowest index; what was passed over is strictly farther than the own entry
            best = all_of.argmin(axis=1)
            least = all_of[np.arange(len(rows)), best]
            code[rows, p] = best
            upper[rows, p] = np.sqrt(least.astype(np.float64)) * UP
            own[rows] = least
            error += own
        return code, upper, lower, error

    def _open(self, p: int, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Which entries may be as near as the own one."""
        may = (lower <= upper[:, None]) & (self.half[p][a] <= upper[:, None])
        may[np.arange(len(a)), a] = False
        return may


def _assigned(rows: DataFrame, books: np.ndarray, before: np.ndarray | None, known: bool, last: bool) -> DataFrame:
    """``rows`` with codes, bounds and errors of a round; ``known``: they have those of the round before; ``last``: only codes go on."""
    parts, k, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast((books, before))
    keep = [f for f in rows.schema.fields if f.name in ("id", "label", "v") and not (last and f.name == "v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("codes")
        assigner = Assigner(*shared.value)
        for b in batches:
            n, v = b.num_rows, parted(b.column("v"), parts, width)

            def read(name: str, kind, *shape: int, n: int = n, b: pa.RecordBatch = b) -> np.ndarray:
                return np.frombuffer(b"".join(b.column(name).to_pylist()), dtype=kind).reshape(n, *shape)

            state = assigner.first(v)
            if known:
                state = read("code", np.uint8, parts), read("upper", "<f4", parts).astype(np.float64), read("lower", "<f2", parts, k).astype(np.float64)
            code, upper, lower, error = assigner.assign(v, *state)
            empty = [b""] * n
            made = [
                [x.tobytes() for x in code],
                empty if last else [x.tobytes() for x in rounded_up(upper).astype("<f4")],
                empty if last else [x.tobytes() for x in rounded_down(lower).astype("<f2")],
            ]
            columns = [*(b.column(f.name) for f in keep), *(pa.array(x, pa.binary()) for x in made), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in keep), "code", "upper", "lower", "error"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keep), _STATE])
    return rows.mapInArrow(run, schema)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: the componentwise floor of the mean of each entry's parts; unused ones as they were."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("codes")
        sums, counts = np.zeros((parts, k, width), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
        for b in batches:
            v = parted(b.column("v"), parts, width)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype=np.uint8).reshape(len(v), parts)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], v[:, p])
                counts[p] += np.bincount(code[:, p], minlength=k)
        p, e = np.nonzero(counts)
        out = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(list(sums[p, e]), pa.list_(pa.int64())), pa.array(counts[p, e])]
        yield pa.RecordBatch.from_arrays(out, names=["part", "entry", "sums", "n"])

    told = rows.select("v", "code").mapInArrow(run, "part int, entry int, sums array<long>, n long")
    total = told.select("part", "entry", "n", F.posexplode_outer("sums").alias("place", "s")).groupBy("part", "entry", "place")
    got = total.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter("place is not null").toArrow()
    out = books.copy()
    part, entry, place, s, n = (got[c].to_numpy() for c in ("part", "entry", "place", "s", "n"))
    out[part, entry, place] = s // n
    return out


def vector_codes(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each sound vector. A codebook has 256 entries at most."""
    spark = ship(df.sparkSession)
    if not (0 < entries <= 256 and parts > 0 and rounds >= 0):
        raise ValueError("entries are 1 to 256, parts 1 or more, rounds 0 or more")
    base = sound_vectors(df, id_col, vec_col, label_col, scale)
    names = beside(id_col, ["code", "error", "label_error", "codebooks_sha256"])
    first = base.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).toArrow()
    if not first.num_rows:
        kind = df.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, {names[0]} string, {names[1]} long, {names[2]} long, {names[3]} string")
    longest = base.agg(F.max(F.size("v"))).first()[0]
    width = -(-longest // parts)
    books = np.ascontiguousarray(parted(first["v"].combine_chunks(), parts, width).transpose(1, 0, 2))
    state, before = base, None
    for k in range(rounds):
        state, old = cut(_assigned(state, books, before, k > 0, False), "bounds"), state
        discard(old)
        before, books = books, _moved(state, books)
    coded = cut(_assigned(state, books, before, rounds > 0, True), "codes")
    discard(state)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # stored, so that its size is known before the join: few labels are broadcast, many are not
    totals = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")), "totals")
    met = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    columns = [F.lower(F.hex("code")), F.col("error"), F.col("label_error"), F.lit(digest)]
    return met.select(F.col("id").alias(id_col), *(c.alias(n) for c, n in zip(columns, names, strict=True)))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _round(n: int) -> str:
    """SQL of one round: the nearest entries, then the moved codebook."""
    moved = f"""
m{n} AS (SELECT p, e, i, CAST(floor(CAST(sum(v.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{n} JOIN v USING (r, p) GROUP BY p, e, i),
c{n + 1} AS (SELECT c.p, c.e, c.i, coalesce(m.x, c.x) AS x FROM c{n} AS c LEFT JOIN m{n} AS m USING (p, e, i)),"""
    return f"""
d{n} AS (SELECT v.r, v.p, c.e, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{n} AS c USING (p, i) GROUP BY v.r, v.p, c.e),
a{n} AS (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{n} GROUP BY r, p),""" + (moved if n < 2 else "")


ORACLE = f"""
WITH kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT r, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM kept),
v AS (SELECT r, j // 4 AS p, j % 4 AS i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM one),
c0 AS (SELECT p, r - 1 AS e, i, x FROM v WHERE r <= 64),{_round(0)}{_round(1)}{_round(2)}
coded AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
told AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), told
"""
