"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text and normalised by length.

Folding lower-cases, maps look-alike letters of other alphabets and, inside words, digits and signs that stand for letters.
The lexicon has stems (word beginnings and whole words) whose log odds in labelled toxic against labelled clean texts are high
beyond chance. Exceptions are phrases of two words, one of them with such a stem, whose log odds for clean texts, among the texts that
have such phrases at all, are high beyond chance. One automaton holds stems and phrases; a match inside a phrase does not count, and each word counts once, by its heaviest
stem. Sums and densities of the weights go through a logistic curve.

All is learned, from at most ``max_labelled`` labelled rows, those with the smallest hashes of their ids. What reaches the driver
comes from that sample alone: its (id, label) pairs, the stems and phrases that are beyond chance in it, and three numbers a row.
Scoring is one pass over all texts without a shuffle.

Edge cases: an empty or null text scores as a text without matches. Rows without an id are scored and count as not held out.
Labels that are null, or differ for one id, teach nothing. With no labelled rows, or those of one class, the lexicon is empty and all
texts score alike, under the threshold. Equal texts score alike; texts are whole, however long. ``score`` and ``drop_toxic`` keep all
columns; a new column whose name is taken gets underscores. Tables without rows give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionweave.llm.common import cut, discard, freed, fresh, parts, resident, ship, table

THRESHOLD = 0.3
#: Without labels: the curve's weights of one, the logarithm of the sum, the density.
CURVE = (-3.0, 1.5, 20.0)
_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a",
}
_OTHER = re.compile("[ıɑɡͰ-ϿЀ-ӿ！-～]")
_MAP = {ord(a): b for a, b in _ALIKE.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_DIGITS = str.maketrans("013457@$!", "oieastasi")
#: Words with such signs, from their first letter or sign; possessive, so that a long run is read once.
_MIXED = re.compile(r"(?<![^\W\d_])(?<![013457@$!])[^\W\d_]*+(?:[013457@$!]++[^\W\d_]++)++")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower-cased text with look-alikes as the letters they stand for; ``l`` and ``i`` become one, as ``1`` is either."""
    t = text.lower()
    if _OTHER.search(t):
        t = t.translate(_MAP).lower()
    if not t.isalpha() and _MIXED.search(t):
        t = _MIXED.sub(lambda m: m[0].translate(_DIGITS) if any(c.isalpha() for c in m[0]) else m[0], t)
    return t.replace("l", "i")


def stems(word: str) -> list[str]:
    """The features of a folded word: its beginnings of three to six letters, and itself; marked as such by spaces."""
    return [" " + word[:k] for k in range(3, min(7, len(word) + 1))] + [f" {word} "]


class Matcher:
    """The automaton of stems with weights, and exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for s, w in weights.items():
            self.automaton.add_word(s, (len(s), w))
        for e in exceptions:
            e = f" {' '.join(_WORD.findall(fold(e)))} "
            self.automaton.add_word(e, (len(e), None))
        self.stems = weights.keys()
        self.automaton.make_automaton()

    def measure(self, text: str) -> tuple[float, int]:
        """The sum of the heaviest weights of its words, and the number of words."""
        words = _WORD.findall(fold(text))
        best: dict[int, float] = {}
        exempt: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton.iter(f" {' '.join(words)} ") if words and len(self.automaton) else ():
            start = end - size + 1
            if w is None:
                exempt.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        for a, b in exempt:
            for s in [s for s in best if a <= s < b]:
                del best[s]
        return sum(best.values()), len(words)


    def phrases(self, text: str) -> set[str]:
        """Each two words of a text that follow each other, if one of them has a stem."""
        words = _WORD.findall(fold(text))
        has = [any(s in self.stems for s in stems(w)) for w in words]
        return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], has, has[1:], strict=False) if x or y}


def curve_inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), total / np.maximum(words, 20)], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_curve(total: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Logistic weights by Newton's method with a ridge; the fixed ones where a class is missing."""
    if len(toxic) < 20 or toxic.min() == toxic.max():
        return CURVE
    x, y = curve_inputs(total, words), toxic.astype(float)
    w = np.zeros(3)
    for _ in range(30):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.05, 0.005])
        step = np.linalg.solve(h, x.T @ (y - p) - np.array([1e-6, 0.05, 0.005]) * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


class Model:
    """Stems, exceptions and curve: plain values that ship with the tasks."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), curve: tuple[float, ...] = CURVE):
        self.weights, self.exceptions, self.curve = tuple(sorted(weights.items())), tuple(sorted(exceptions)), curve

    def matcher(self) -> Matcher:
        return resident(("toxicity", self.weights, self.exceptions), lambda: Matcher(dict(self.weights), self.exceptions))

    def measures(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        m = self.matcher()
        got = [m.measure(t or "") for t in texts]
        return np.array([g[0] for g in got], dtype=float), np.array([g[1] for g in got], dtype=float)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(curve_inputs(*self.measures(texts)) @ np.array(self.curve)) if texts else np.zeros(0)


def most_specific(found: dict[str, tuple[float, int]], share: float = 0.9) -> dict[str, float]:
    """The weights of those stems that no single longer one stands for: none has ``share`` of its toxic texts."""
    longer: dict[str, int] = {}
    for s, (_, n) in found.items():
        word = s.strip()
        for shorter in stems(word)[:-1]:
            if len(shorter) < len(s):
                longer[shorter] = max(longer.get(shorter, 0), n)
    return {s: w for s, (w, n) in found.items() if longer.get(s, 0) < share * n}


def fold_of(id_col: str):
    """crc32 of the id's text modulo 4; 2 is held out from all learning."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


#: Entries of a task's table of counts, which then goes on and begins anew.
HELD = 100_000
COUNTS = ("clean0", "toxic0", "clean3", "toxic3")


def counted(taught: DataFrame, features) -> DataFrame:
    """(item, clean0, toxic0, clean3, toxic3): of each feature of texts, the texts that have it, by part and label; the item '' has
    all texts with any. Written. ``features`` gives a function of a text, which gives the set of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, rows = features(), {}, [0] * 4

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in range(4))], names=["item", *COUNTS])

        for b in parts(batches):
            for t, y, part in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                some = of(t or "")
                rows[2 * part + y] += bool(some)
                for s in some:
                    if (v := held.get(s)) is None:
                        held[s] = v = [0] * 4
                    v[2 * part + y] += 1
                if len(held) > HELD:
                    yield out()
                    held = {}
        held[""] = rows
        yield out()
        held = {}
        freed()

    schema = ", ".join(["item string", *(f"{c} long" for c in COUNTS)])
    return cut(taught.mapInArrow(run, schema).groupBy("item").agg(*(F.sum(c).alias(c) for c in COUNTS)), "counts")


def beyond_chance(counts: DataFrame, of: str, against: str, ks: tuple[int, ...], z: float, least: float) -> list:
    """Rows (item, n, w): items in three texts of one label or more whose log odds against the other, less z standard errors, reach
    ``least``; ``ks`` are the parts that count."""
    rows = counts.filter("item = ''").first()
    n_of, n_against = (sum(rows[f"{c}{p}"] for p in ks) if rows else 0 for c in (of, against))
    if not n_of or not n_against:
        return []
    x, y = (sum(F.col(f"{c}{p}") for p in ks) for c in (of, against))
    odds = F.log((x + 0.5) / (n_of + 1)) - F.log((y + 0.5) / (n_against + 1))
    sure = odds - z * F.sqrt(1 / (x + 0.5) + 1 / (y + 0.5))
    return counts.filter((F.col("item") != "") & (x >= 3) & (sure >= least)).select("item", x.alias("n"), odds.alias("w")).collect()


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 40_000, z: float = 2.0, least: float = 1.0
) -> Model:
    """Learn stems and exceptions from the labelled rows outside fold 2, the curve from those of fold 3 under what folds 0 and 1 teach.

    The bounded sample of ids is broadcast to the scan of the texts, so no text is shuffled.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna()
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_most")).filter("_y = _most and _y in (0, 1)").drop("_most")
    known = known.withColumn("_fold", fold_of("_id")).filter("_fold <> 2")
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled).select("_id", "_y", (F.col("_fold") == 3).cast("int").alias("_part"))
    taught = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id").select("_text", "_y", "_part")

    def word_stems():
        resident("toxicity")
        return lambda t: {s for w in set(_WORD.findall(fold(t))) if len(w) > 2 for s in stems(w)}

    counts = counted(taught, word_stems)

    def lexicon(ks: tuple[int, ...]) -> dict[str, float]:
        return most_specific({r["item"]: (float(r["w"]), r["n"]) for r in beyond_chance(counts, "toxic", "clean", ks, z, least)})

    first, whole = Model(lexicon((0,))), Model(lexicon((0, 3)))
    both = Model(dict(first.weights) | dict(whole.weights))
    phrases = counted(taught, lambda: both.matcher().phrases)

    def exceptions(ks: tuple[int, ...]) -> tuple[str, ...]:
        return tuple(r["item"] for r in beyond_chance(phrases, "clean", "toxic", ks, z, least))

    first = Model(dict(first.weights), exceptions((0,)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            total, words = first.measures(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(words), b.column(1)], names=["total", "words", "y"])

    # three numbers for each labelled row of the sample, under the same bound should ids repeat
    rest = taught.filter("_part = 1").select("_text", "_y").mapInArrow(measure, "total double, words double, y int").orderBy(F.xxhash64("total", "words", "y")).limit(max_labelled).toPandas()
    curve = fit_curve(rest["total"].to_numpy(float), rest["words"].to_numpy(float), rest["y"].to_numpy(int))
    model = Model(dict(whole.weights), exceptions((0, 3)), curve)
    discard(counts, phrases)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score for each row, in one pass."""
    ship(docs.sparkSession)
    out_col = fresh(docs, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            got = pa.array(model.scores(b.column(text_col).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with their own columns."""
    out = fresh(docs, "score")
    return score(docs, learn(docs, labels, id_col, text_col), text_col, out).filter(F.col(out) < threshold).drop(out)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold_of("doc_id") == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
