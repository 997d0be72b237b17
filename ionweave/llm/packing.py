"""Vector bin packing of token sequences under simultaneous limits, by the dot-product heuristic.

A sequence has room for so many tokens, segments and loss-bearing tokens. Of the pieces at hand, the one whose demand has
the largest weighted dot product with the room left goes in; each limit is weighted by the mean demand on it. When none
fits whole, the best one is cut at the room left and its rest stays at hand. Documents longer than a sequence are first cut into pieces
that leave a sixteenth of it to others. Documents are packed where they are read, without a shuffle: a task holds a window of pieces.

The ids of a row's prompt bear no loss; where rows have no prompts, a document's first ``context`` ids bear none, as too little stands
before them. So the three limits differ: of long documents alone, sequences would be full of loss-bearing ids before they are full.

A sequence is padded to ``max_tokens`` unless its length is a power of two. What a limit or the end of a task leaves short is
therefore cut into sequences whose lengths are powers of two, the largest first: they need no padding.

The number of a sequence is its task's number times 2**32 plus its number in the task. A task that is run again reads
the same rows and packs them alike.

Edge cases: a null or empty text is its end id alone, a null id stays null, ids may be of any type, and prompts that are null are empty.
Texts are whole, however long. Equal rows are packed as often as they occur. Other columns are neither read nor returned; a result's
column that has the id's name gets an underscore. A table without rows gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ionweave.llm.common import beside, freed, parts, ship, table
from ionweave.llm.words import loaded


@dataclass
class Piece:
    """Ids ``start`` to ``start + size`` of a row; the first ``free`` of them bear no loss."""

    row: object
    ids: bytes  # of the whole row
    start: int
    size: int
    free: int
    total: int

    @property
    def loss(self) -> int:
        return self.size - self.free

    def head(self, tokens: int, loss: int) -> int:
        """How many leading ids fit in so many tokens and loss-bearing tokens."""
        return min(self.size, tokens, self.free + loss)

    def split(self, n: int) -> tuple[Piece, Piece]:
        free = min(n, self.free)
        return Piece(self.row, self.ids, self.start, n, free, self.total), Piece(self.row, self.ids, self.start + n, self.size - n, self.free - free, self.total)


class Packer:
    """Takes pieces one by one; gives sequences, which are lists of pieces."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, window: int):
        if min(max_tokens, max_segments, max_loss, window) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=float)
        self.window = window
        self.waiting: list[Piece] = []

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        tokens, _, loss = map(int, self.limits)
        while piece.size > tokens:
            first, piece = piece.split(piece.head(max(1, tokens - tokens // 16), loss))
            self.waiting.append(first)
        self.waiting.append(piece)
        if len(self.waiting) >= 2 * self.window:
            yield from self._pack(self.window)

    def flush(self) -> Iterator[list[Piece]]:
        yield from self._pack(0)

    def _pack(self, leave: int) -> Iterator[list[Piece]]:
        """Sequences from what waits, until at most ``leave`` pieces do."""
        pieces = self.waiting
        demand = np.array([(p.size, 1, p.loss) for p in pieces], dtype=float).reshape(-1, 3)
        alive = np.ones(len(pieces), dtype=bool)
        left = len(pieces)
        while left > leave:
            room, sequence = self.limits.copy(), []
            weights = demand[alive].mean(axis=0) / self.limits**2
            while left and room[0] and room[1]:
                score = demand @ (weights * room)
                score[~alive] = -1
                if room[1] > 1:  # the last segment may be cut to fill the sequence
                    fits = alive & (demand <= room).all(axis=1)
                    if fits.any():
                        score[~fits] = -1
                k = int(np.argmax(score))
                n = pieces[k].head(int(room[0]), int(room[2]))
                if not n:  # only loss-bearing ids wait and the loss limit is reached
                    free = np.flatnonzero(alive & (demand[:, 0] > demand[:, 2]))
                    free = [i for i in free if pieces[i].head(int(room[0]), 0)]
                    if not free:
                        break
                    k = free[0]
                    n = pieces[k].head(int(room[0]), int(room[2]))
                first, rest = pieces[k].split(n)
                sequence.append(first)
                room -= (first.size, 1, first.loss)
                pieces[k] = rest
                demand[k] = (rest.size, 1, rest.loss)
                if not rest.size:
                    alive[k] = False
                    left -= 1
            yield from even(sequence, int(self.limits[0]))
        self.waiting = [p for p, on in zip(pieces, alive, strict=True) if on]


def even(sequence: list[Piece], tokens: int) -> Iterator[list[Piece]]:
    """The sequence, or where it is short, sequences of it whose lengths are powers of two."""
    left = sum(p.size for p in sequence)
    if left == tokens:
        yield sequence
        return
    waiting = sequence[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        some: list[Piece] = []
        while room:
            piece = waiting.pop()
            if piece.size > room:
                piece, rest = piece.split(room)
                waiting.append(rest)
            some.append(piece)
            room -= piece.size
        yield some


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    vocab: str | None = None,
    end_id: int = 2,
    max_tokens: int = 4096,
    max_segments: int = 32,
    max_loss: int = 4064,
    context: int = 16,
    window: int = 512,
    with_ids: bool = False,
    memo: int = 300_000,
) -> DataFrame:
    """The pieces of all rows and their places in sequences.

    A row's ids are those of its prompt, then of its text, then ``end_id``. Columns: id, start, length, ids_crc32, doc_tokens,
    loss_tokens, sequence_id, offset, and with ``with_ids`` the ids. ``memo`` words or more are remembered by a worker, for speed.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words = loaded(vocab or public_tokenizers.path("word_bpe_49k.json"), memo)
        packer = Packer(max_tokens, max_segments, max_loss, window)
        number = TaskContext.get().partitionId() << 32
        end = np.array([end_id], "<u4").tobytes()

        def out(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            cols: list[list] = [[] for _ in names]
            for s in sequences:
                offset = 0
                for p in s:
                    ids = p.ids[4 * p.start : 4 * (p.start + p.size)]
                    row = (p.row, p.start, p.size, zlib.crc32(ids), p.total, p.loss, number, offset)
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
                    if with_ids:
                        cols[-1].append(np.frombuffer(ids, "<u4").astype(np.int32))
                    offset += p.size
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow, strict=True)], names=names)

        done: list[list[Piece]] = []
        for b in parts(batches):
            texts = [x or "" for x in b.column(1).to_pylist()]
            heads = words.encode_all([x or "" for x in b.column(2).to_pylist()]) if prompt_col else iter([b""] * len(texts))
            for row, head, ids in zip(b.column(0).to_pylist(), heads, words.encode_all(texts), strict=True):
                whole = head + ids + end
                n = len(whole) // 4
                for s in packer.add(Piece(row, whole, 0, n, len(head) // 4 if prompt_col else min(context, n), n)):
                    done.append(s)
                    if len(done) >= 256:
                        yield out(done)
                        done = []
        for s in packer.flush():
            done.append(s)
            if len(done) >= 256:
                yield out(done)
                done = []
        if done:
            yield out(done)
        freed()

    names = [id_col, *beside(id_col, ["start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"])]
    kinds: list[T.DataType] = [docs.schema[id_col].dataType, *[T.LongType()] * 7]
    if with_ids:
        names, kinds = [*names, *beside(id_col, ["ids"])], [*kinds, T.ArrayType(T.IntegerType())]
    arrow = [to_arrow_type(k, prefers_large_types=False) for k in kinds]
    schema = T.StructType([T.StructField(*x) for x in zip(names, kinds, strict=True)])
    return docs.select(id_col, text_col, *([prompt_col] if prompt_col else [])).mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
