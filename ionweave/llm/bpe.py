"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The text is cut into pieces by the vocabulary's own pattern; in each piece, a segment tree over its adjacent pairs
holds ``rank * size + position`` at the leaves and the minimum at each inner node. Its root is thus the leftmost pair of
lowest rank. A merge changes three leaves, each in logarithmic time, until no pair has a rank. Pieces of one tree size
are run side by side in numpy; long pieces have a tree of their own.

Edge cases: a null or empty text has no ids; its decoded text is empty. A text that holds a special token's string gets
that token's id, as the tokenizers library does by default. Texts are whole, however long. Equal rows give equal rows.
``round_trip`` neither reads nor returns columns other than the id and the text, ``encode_column`` keeps all; a new column whose name
is taken gets underscores. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ionweave.llm.caching import Memo
from ionweave.llm.common import beside, fresh, parts, resident, ship, table

#: White space as Unicode has it. Python's own class also has the four separators 1C to 1F, the tokenizers' has not.
_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_SPACE}\\p{{L}}\\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
NONE = np.int64(2**62)
#: Pieces with trees above this many leaves run alone.
WIDE = 64
#: Characters of text whose pieces are in memory together.
SLICE = 1_000_000


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Bpe:
    """A byte-level vocabulary file of the tokenizers library, as an encoder and decoder."""

    def __init__(self, path: str, memo: int = 300_000):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], dtype=np.int64)
        pairs = {}
        for rank, merge in enumerate(file["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.pairs = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = np.append(keys, NONE)
        self.rank = np.array([pairs[int(k)][0] for k in keys] + [-1], dtype=np.int64)
        self.made = np.array([pairs[int(k)][1] for k in keys] + [-1], dtype=np.int64)
        back = {c: b for b, c in enumerate(chars)}
        added = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in added else bytes(back[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.memo = Memo(self.encode_pieces, memo)

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        raw = [p.encode() for p in pieces]
        out: list[tuple[int, ...]] = [()] * len(raw)
        sizes: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) == 1:
                out[i] = (int(self.first[b[0]]),)
            else:
                sizes.setdefault(1 << max(1, (len(b) - 1).bit_length()), []).append(i)
        for size, which in sizes.items():
            if size > WIDE:
                for i in which:
                    out[i] = tuple(self._alone(raw[i], size))
                continue
            for at in range(0, len(which), 1 << 14):
                some = which[at : at + (1 << 14)]
                for i, ids in zip(some, self._together([raw[i] for i in some], size), strict=True):
                    out[i] = ids
        return out

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray | int, size: int) -> np.ndarray:
        """Leaf values of pairs; NONE where the pair has no rank or ``right`` is negative, for no neighbour."""
        keys = left << 32 | np.maximum(right, 0)
        found = np.searchsorted(self.keys, keys)
        return np.where((right >= 0) & (left >= 0) & (self.keys[found] == keys), self.rank[found] * size + at, NONE)

    def _together(self, raw: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Ids of pieces of at most ``size`` + 1 bytes, a tree each, all merged in step."""
        n = len(raw)
        width = size + 2  # a last column stays -1: no neighbour
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=n)
        symbols = np.full((n, width), -1, dtype=np.int64)
        inside = np.arange(width) < lengths[:, None]
        symbols[inside] = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        after = np.tile(np.minimum(np.arange(1, width + 1), width - 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        before[:, 0] = width - 1
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        tree[:, size:] = self._leaves(symbols[:, :size], symbols[:, 1 : size + 1], np.arange(size), size)
        for level in range(size.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while live.size:
            pos = tree[live, 1] & (size - 1)
            right = after[live, pos]
            keys = symbols[live, pos] << 32 | symbols[live, right]
            symbols[live, pos] = self.made[np.searchsorted(self.keys, keys)]
            symbols[live, right] = -1
            beyond = after[live, right]
            after[live, pos] = beyond
            before[live, beyond] = pos
            prior = before[live, pos]
            has = prior < width - 1
            self._set(tree, live, np.minimum(right, size - 1), np.where(right < size, NONE, tree[live, 2 * size - 1]), size)
            self._set(tree, live, pos, self._leaves(symbols[live, pos], symbols[live, beyond], pos, size), size)
            some = live[has]
            p = prior[has]
            self._set(tree, some, p, self._leaves(symbols[some, p], symbols[some, pos[has]], p, size), size)
            live = live[tree[live, 1] < NONE]
        kept = symbols >= 0
        flat, ends = symbols[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, size: int) -> None:
        node = leaf + size
        tree[rows, node] = value
        while size > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            size >>= 1

    def _alone(self, raw: bytes, size: int) -> list[int]:
        """The ids of one long piece."""
        n, pairs, none = len(raw), self.pairs, int(NONE)
        symbols = self.first[np.frombuffer(raw, dtype=np.uint8)].tolist()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]

        def value(i: int, j: int) -> int:
            got = pairs.get(symbols[i] << 32 | symbols[j]) if i >= 0 and j >= 0 else None
            return got[0] * size + i if got else none

        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = value(i, i + 1)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, v: int) -> None:
            k = leaf + size
            tree[k] = v
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                v = a if a < b else b
                if tree[k] == v:
                    break
                tree[k] = v
                k >>= 1

        while tree[1] < none:
            i = tree[1] % size
            j = after[i]
            symbols[i] = pairs[symbols[i] << 32 | symbols[j]][1]
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            put(j, none) if j < size else None
            put(i, value(i, after[i]))
            if before[i] >= 0:
                put(before[i], value(before[i], i))
        out, i = [], 0
        while i >= 0:
            out.append(symbols[i])
            i = after[i]
        return out

    def pieces(self, text: str) -> list:
        """The pieces of a text; a special token stands as its id."""
        if not self.special or not any(x in text for x in self.added):
            return PIECES.findall(text)
        out: list = []
        for k, part in enumerate(self.special.split(text)):
            out += [self.added[part]] if k % 2 else PIECES.findall(part)
        return out

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        at = 0
        while at < len(texts):
            cut, total = [], 0
            while at < len(texts) and (not cut or total + len(texts[at]) <= SLICE):
                total += len(texts[at])
                cut.append(self.pieces(texts[at]))
                at += 1
            need = set().union(*cut)
            odd = {x for x in need if isinstance(x, int)}
            ids = self.memo.ready(need - odd)
            if odd:
                ids = ids | {x: (x,) for x in odd}
            for p in cut:
                yield [x for piece in map(ids.__getitem__, p) for x in piece]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens as their strings; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def loaded(path: str) -> Bpe:
    return resident(("bpe", path), lambda: Bpe(path))


def _strings(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def encode_column(docs: DataFrame, text_col: str = "text", out_col: str = "ids", vocab: str | None = None) -> DataFrame:
    """``docs`` with the ids of its text column. ``vocab`` is the file's place on the executors (None: the package's)."""
    ship(docs.sparkSession)
    out_col = fresh(docs, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(_strings(vocab))
        for b in parts(batches):
            texts = [x or "" for x in b.column(text_col).to_pylist()]
            ids = pa.array(list(bpe.encode_all(texts)), type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """Encode each whole text, decode the ids, and give digests of both: id, n_tokens, ids_sha256, decoded_sha256.

    One pass without a shuffle. A worker holds the pieces of a million characters, or of one longer text, and a bounded
    memo of pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(_strings(vocab))
        digits = [str(i) for i in range(len(bpe.bytes_of))]
        sha = hashlib.sha256
        for b in parts(batches):
            texts = [x or "" for x in b.column(1).to_pylist()]
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_all(texts):
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=names)

    ship(docs.sparkSession)
    names = [id_col, *beside(id_col, ["n_tokens", "ids_sha256", "decoded_sha256"])]
    kinds = [docs.schema[id_col].dataType, T.LongType(), T.StringType(), T.StringType()]
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(*x) for x in zip(names, kinds, strict=True)]))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
