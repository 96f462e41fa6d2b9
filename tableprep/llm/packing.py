"""Packing as vector bin packing: examples are placed under limits on tokens, segments and loss-bearing tokens at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tableprep.llm.text import arrow_map, kept, utf8
from tableprep.llm.tokens import WordIds


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


@dataclass
class Piece:
    """Part of an example from token ``start`` on; ``loss`` marks the loss-bearing ids, None: all of them."""

    example: int
    start: int
    ids: np.ndarray
    loss: np.ndarray | None

    def weight(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def split(self, at: int) -> tuple[Piece, Piece]:
        """The first ``at`` tokens and the rest."""
        a, b = (None, None) if self.loss is None else (self.loss[:at], self.loss[at:])
        return Piece(self.example, self.start, self.ids[:at], a), Piece(self.example, self.start + at, self.ids[at:], b)


class Packer:
    """Fills one sequence after another from a pool of waiting pieces.

    The next piece of a sequence is the one that fits all limits and whose demand vector (tokens, segments, loss tokens,
    each as a share of its limit) has the largest dot product with what the sequence has left. With ``cut``, a sequence
    that no whole piece fits is filled by the head of a waiting one, and a sequence closed early keeps a power of two
    of tokens, the rest waiting again; without, pieces longer than a sequence are still split, nothing else is.
    """

    def __init__(self, limits: Limits, cut: bool, pool: int = 2048):
        if min(limits.tokens, limits.segments, limits.loss_tokens, pool) < 1:
            raise ValueError("Limits and pool must be positive")
        self.limits, self.cut, self.pool = limits, cut, pool
        self.most = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.waiting: list[Piece] = []
        self.need = np.zeros((2 * pool + 64, 3))

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes an example; yields the sequences that are complete."""
        while len(piece.ids) >= self.limits.tokens or piece.weight() > self.limits.loss_tokens:
            head, piece = piece.split(self._fitting(piece))
            if len(head.ids) == self.limits.tokens:
                yield [head]
            else:
                self._wait(head)
        if len(piece.ids):
            self._wait(piece)
        while len(self.waiting) >= self.pool:
            yield self._next()

    def finish(self) -> Iterator[list[Piece]]:
        while self.waiting:
            yield self._next()

    def _fitting(self, piece: Piece) -> int:
        """Tokens from the front of the piece that one empty sequence takes."""
        size = min(len(piece.ids), self.limits.tokens)
        if piece.loss is not None:
            size = min(size, int(np.searchsorted(np.cumsum(piece.loss), self.limits.loss_tokens, "right")))
        return size

    def _wait(self, piece: Piece) -> None:
        n = len(self.waiting)
        if n == len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.need[n] = (len(piece.ids), 1, piece.weight())
        self.waiting.append(piece)

    def _take(self, k: int) -> Piece:
        piece, last = self.waiting[k], self.waiting.pop()
        if piece is not last:
            self.waiting[k] = last
            self.need[k] = self.need[len(self.waiting)]
        return piece

    def _next(self) -> list[Piece]:
        sequence: list[Piece] = []
        left = self.most.copy()
        while self.waiting and left[0] > 0 and left[1] > 0:
            need = self.need[: len(self.waiting)]
            score = np.where((need <= left).all(axis=1), need @ (left / self.most**2), -1.0)
            best = int(score.argmax())
            if score[best] < 0:
                if not self.cut:
                    break
                piece = self._take(int(need[:, 0].argmax()))
                size = int(min(left[0], len(piece.ids)))
                if piece.loss is not None:
                    size = min(size, int(np.searchsorted(np.cumsum(piece.loss), left[2], "right")))
                if not size:
                    self._wait(piece)
                    break
                piece, rest = piece.split(size)
                if len(rest.ids):
                    self._wait(rest)
            else:
                piece = self._take(best)
            sequence.append(piece)
            left -= (len(piece.ids), 1, piece.weight())
        return self._closed(sequence, int(left[0])) if self.cut and left[0] > 0 else sequence

    def _closed(self, sequence: list[Piece], left: int) -> list[Piece]:
        """Keeps the largest power of two of the tokens; such a sequence needs no padding."""
        size = self.limits.tokens - left
        over = size - (1 << (size.bit_length() - 1))
        while over:
            piece = sequence.pop()
            keep = max(0, len(piece.ids) - over)
            over -= len(piece.ids) - keep
            head, rest = piece.split(keep)
            if keep:
                sequence.append(head)
            self._wait(rest)
        return sequence


def pack_texts(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, limits: Limits = Limits(), cut: bool = True,
    with_ids: bool = True,
) -> DataFrame:
    """Packs the ids of every text, with ``end_id`` after them: one row for each piece.

    ``key``, ``start`` (ids of its text before it), ``length``, ``ids_crc32`` (of the ids as little-endian unsigned
    32-bit numbers), ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence, and the ids. Each task packs the texts
    of its partition from a pool of bounded size, so nothing is shuffled and a task that runs again gives the same
    rows; sequences are numbered by partition. All but the last few sequences of a task are full; those are cut to
    powers of two.

    A null or empty text has only ``end_id``; repeated rows are packed again; an empty table gives no rows; null keys
    are kept; further columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def examples(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, None]]:
        for raw in utf8(b["text"]):
            yield np.append(_words(tokenizer).encode(raw), np.uint32(end_id)).astype(np.uint32), None

    packed = arrow_map(docs, {"key": key, "text": text}, _packed(examples, limits, cut, with_ids), _schema(kind, with_ids), tokenizer)
    return packed.withColumnRenamed("key", key)


def pack_examples(df: DataFrame, key: str, ids: str, loss: str, limits: Limits = Limits(), cut: bool = False, with_ids: bool = True) -> DataFrame:
    """Packs examples given as arrays of ids and of loss marks (instruction data), by default without cutting them.

    A null list of ids is empty and gives no piece; a null or shorter list of marks, or a null mark, bears no loss
    there. Else as :func:`pack_texts`.
    """
    kind = df.schema[key].dataType.simpleString()

    def examples(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for tokens, marks in zip(b["ids"].to_pylist(), b["loss"].to_pylist()):
            full = np.zeros(len(tokens or []), bool)
            full[: len(marks or [])] = [bool(m) for m in (marks or [])[: len(full)]]
            yield np.array(tokens or [], np.uint32), full

    return arrow_map(df, {"key": key, "ids": ids, "loss": loss}, _packed(examples, limits, cut, with_ids), _schema(kind, with_ids)).withColumnRenamed("key", key)


def conversation_examples(talks: DataFrame, tokenizer: str, key: str = "conv_id", turns: str = "turns", end_id: int = 2, answers: str = "assistant") -> DataFrame:
    """(key, ids, loss) of conversations, as :func:`pack_examples` takes them.

    ``turns`` are an array of (role, text). The ids of every turn, each turn encoded by itself, end with ``end_id``;
    those of turns by ``answers``, their end included, bear loss. A null text is empty; a null turn and a null list have
    no ids; a null role bears no loss; repeated rows and null keys are kept; further columns are not read.
    """
    kind = talks.schema[key].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(tokenizer), np.array([end_id], np.int32)
        for b in batches:
            ids, loss = [], []
            for said in b["turns"].to_pylist():
                coded = [(np.append(words.encode((t["text"] or "").encode()).astype(np.int32), end), t["role"] == answers) for t in said or [] if t]
                ids.append(np.concatenate([c for c, _ in coded]) if coded else np.zeros(0, np.int32))
                loss.append(np.repeat([answer for _, answer in coded], [len(c) for c, _ in coded]).astype(bool))
            yield pa.RecordBatch.from_arrays(
                [b["key"], pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_()))], ["key", "ids", "loss"],
            )

    made = arrow_map(talks, {"key": key, "turns": turns}, work, f"key {kind.simpleString()}, ids array<int>, loss array<boolean>", tokenizer)
    return made.withColumnRenamed("key", key)


def _words(path: str) -> WordIds:
    return kept(path, lambda: WordIds(path))


def _schema(kind: str, with_ids: bool) -> str:
    return f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids


def _packed(examples, limits: Limits, cut: bool, with_ids: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut)
        first = TaskContext.get().partitionId() << 32
        known: dict[int, tuple] = {}  # keys and sizes of the examples that still wait
        number = sequences = 0
        for b in batches:
            done = []
            for key, (ids, loss) in zip(b["key"].to_pylist(), examples(b)):
                known[number] = (key, len(ids), len(ids))
                if not len(ids):
                    del known[number]
                done += packer.add(Piece(number, 0, ids, loss))
                number += 1
            yield rows(done, known, first + sequences, b.schema.field("key").type)
            sequences += len(done)
            kind = b.schema.field("key").type
        done = list(packer.finish())
        if done:
            yield rows(done, known, first + sequences, kind)

    def rows(done: list[list[Piece]], known: dict[int, tuple], at: int, kind: pa.DataType) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8)]
        for k, sequence in enumerate(done):
            offset = 0
            for piece in sequence:
                key, size, open_ids = known[piece.example]
                ids = np.ascontiguousarray(piece.ids, "<u4")
                for column, value in zip(out, (key, piece.start, len(ids), zlib.crc32(ids.tobytes()), size, at + k, offset)):
                    column.append(value)
                if with_ids:
                    out[7].append(ids.astype(np.int32))
                offset += len(ids)
                if open_ids == len(ids):
                    del known[piece.example]
                else:
                    known[piece.example] = (key, size, open_ids - len(ids))
        arrays = [pa.array(out[0], kind), *[pa.array(c, pa.int64()) for c in out[1:7]]]
        names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays, names = [*arrays, pa.array(out[7], pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names)

    return work
