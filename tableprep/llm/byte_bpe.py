"""Byte-level BPE by DuckDB recursive queries in each task, and decoding by ordered aggregation."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tableprep.llm.text import arrow_map, kept

# Rows of one recursive query or one ordered aggregation; a word of more bytes is a query of its own.
SLICE = 1 << 18
# Characters of a text that are split into words at a time.
CHUNK = 1 << 16
# Words of more bytes keep only their last state and contract all places of their pair; see MERGE_LONG.
LONG = 64

# A round joins neighbouring tokens of the words that still change to the merge table and contracts each word's first
# pair of least rank. It gives all rows of these words; those of a word without a pair are done.
MERGE = """
WITH RECURSIVE parts(word, pos, id, done) AS (
  SELECT word, pos, id, false FROM fresh
  UNION ALL
  (WITH live AS MATERIALIZED (
     SELECT word, pos, id, lead(id) OVER w AS next_id, row_number() OVER w AS n
     FROM parts WHERE NOT done WINDOW w AS (PARTITION BY word ORDER BY pos)),
   pairs AS (SELECT l.word, l.n, m.merged FROM live l JOIN merges m ON m.a = l.id AND m.b = l.next_id),
   least AS MATERIALIZED (SELECT word, min(merged) AS merged, min_by(n, (merged, n)) AS n FROM pairs GROUP BY word)
   SELECT l.word, l.pos, CASE WHEN l.n = least.n THEN least.merged ELSE l.id END, least.word IS NULL
   FROM live l LEFT JOIN least ON least.word = l.word
   WHERE l.n - 1 IS DISTINCT FROM least.n)
)
SELECT word, pos, id FROM parts WHERE done ORDER BY word, pos"""

# One row for each byte throughout: of a contracted pair the left row gets the merged id, the right one -1. A round takes
# up the words that changed in the last one.
MERGE_LONG = """
WITH RECURSIVE parts(word, pos, id) USING KEY (word, pos) AS (
  SELECT word, pos, id FROM fresh
  UNION
  (WITH live AS (
     SELECT word, pos, id, lead(id) OVER w AS next_id, lead(pos) OVER w AS next_pos, row_number() OVER w AS n
     FROM recurring.parts WHERE id >= 0 AND word IN (SELECT word FROM parts) WINDOW w AS (PARTITION BY word ORDER BY pos)),
   pairs AS (SELECT l.word, l.pos, l.next_pos, l.n, m.merged FROM live l JOIN merges m ON m.a = l.id AND m.b = l.next_id),
   least AS (SELECT word, min(merged) AS merged FROM pairs GROUP BY word),
   hits AS (SELECT p.*, p.n - row_number() OVER (PARTITION BY p.word ORDER BY p.n) AS run FROM pairs p JOIN least USING (word, merged)),
   places AS (
     SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY n) AS in_run, row_number() OVER (PARTITION BY word ORDER BY n) AS in_word
     FROM hits)
   SELECT word, unnest([pos, next_pos]), unnest([merged, -1]) FROM places WHERE {taken})
)
SELECT word, pos, id FROM parts WHERE id >= 0 ORDER BY word, pos"""
FIRST_PLACE = "in_word = 1"
# All places of the least pair at once; of overlapping ones (x x x) every second, from the left.
ALL_PLACES = "in_run % 2 = 1"

DECODE = """
SELECT row, string_agg(shown, '' ORDER BY pos) AS shown, count(*) FILTER (shown IS NULL) AS unknown
FROM coded LEFT JOIN vocabulary USING (id) GROUP BY row ORDER BY row"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def contract(word: bytes, ranks: dict[bytes, int]) -> Iterator[int]:
    """Ranks of a word's contractions, in order, by the definition."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return
        rank, at = min(found)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        yield rank


@lru_cache(maxsize=4)
def merges_in_order(path: str) -> bool:
    """Whether every token of the file contracts to itself, in steps of no higher rank than its own.

    Then, while the least rank among a word's pairs is r, contracting one place never makes a pair below r: such a pair
    would spell a token of lower rank, whose own steps, all below r, would have been done before. So all places of the
    least pair may be contracted in one round.
    """
    ranks = read_ranks(path)
    for token, rank in ranks.items():
        steps = list(contract(token, ranks))
        if len(steps) != len(token) - 1 or steps and max(steps) > rank:
            return False
    return True


def splitters(pattern: str) -> tuple[re.Pattern, object]:
    """The pattern for texts of ASCII alone, which the standard library splits faster, and for all texts."""
    ascii_form = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
    ascii_form = ascii_form.replace("[A-Za-z]", "A-Za-z").replace("[0-9]", "0-9")
    ascii_form = re.sub(r"(?<!\\s)(A-Za-z|0-9)(?=\+)", r"[\1]", ascii_form)
    return re.compile(ascii_form, re.ASCII), regex.compile(pattern)


class Words(dict):
    """Place of every word in the order of first sight; ``fresh`` lists those whose ids are not known yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.fresh.append(word)
        return place


class Merger:
    """The merge table and vocabulary of one rank file in a task's own DuckDB, and the ids of words seen.

    ``words`` maps a word to its place in the arrays; once it holds more than ``most`` words it is emptied and begins
    anew with the next slice of texts.
    """

    def __init__(self, path: str, pattern: str, together: bool, most: int = 400_000):
        self.ranks, self.most = read_ranks(path), most
        self.ascii, self.any = splitters(pattern)
        self.gap = regex.compile(r"(?<=\S)\s")
        self.merge_long = MERGE_LONG.format(taken=ALL_PLACES if together else FIRST_PLACE)
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self._table("merges", np.array(rows, np.int32).reshape(-1, 3).T, ("a", "b", "merged"))
        shown = [t.decode("latin-1") for t in self.ranks]
        self._table("vocabulary", [pa.array(list(self.ranks.values()), pa.int32()), shown], ("id", "shown"))
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError(f"{path} lacks tokens of single bytes")
        self.clear()

    def _table(self, name: str, columns, names: tuple[str, ...]) -> None:
        self.db.register("loaded", pa.table(dict(zip(names, columns))))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM loaded")
        self.db.unregister("loaded")

    def clear(self) -> None:
        self.words = Words()
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def split(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches, some ten thousand at a time: a text is cut where white space follows another character."""
        found = (self.ascii if text.isascii() else self.any).findall
        at = 0
        while at < len(text):
            gap = self.gap.search(text, at + CHUNK)
            end = gap.start() if gap else len(text)
            yield found(text[at:end])
            at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        done: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0
        for row, text in enumerate(texts):
            for found in self.split(text):
                waiting.append((row, np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))))
                held += len(found)
                if held >= SLICE:
                    self._settle(waiting, done)
                    waiting, held = [], 0
        self._settle(waiting, done)
        return [parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in done]

    def _settle(self, waiting: list[tuple[int, np.ndarray]], done: list[list[np.ndarray]]) -> None:
        self._learn()
        for row, places in waiting:
            sizes = self.sizes[places]
            before = np.cumsum(sizes) - sizes
            done[row].append(self.flat[np.repeat(self.starts[places] - before, sizes) + np.arange(sizes.sum())])
        if len(self.words) > self.most:
            self.clear()

    def _learn(self) -> None:
        """Stores the ids of fresh words: the id itself where the word is a token, else by a recursive query."""
        fresh, self.words.fresh = [w.encode() for w in self.words.fresh], []
        place = len(self.words) - len(fresh)
        whole = [(place + i, self.ranks[w]) for i, w in enumerate(fresh) if w in self.ranks]
        if whole:
            places, ids = (np.array(c) for c in zip(*whole))
            self._keep(places, ids, np.ones(len(ids), np.int64))
        for long in (False, True):
            slice_, held = [], 0
            for i, w in enumerate(fresh):
                if w in self.ranks or (len(w) > LONG) != long:
                    continue
                if slice_ and held + len(w) > SLICE:
                    self._contract(slice_, long)
                    slice_, held = [], 0
                slice_.append((place + i, w))
                held += len(w)
            if slice_:
                self._contract(slice_, long)

    def _contract(self, words: list[tuple[int, bytes]], long: bool) -> None:
        raw = b"".join(w for _, w in words)
        sizes = np.array([len(w) for _, w in words])
        row = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self._table("fresh", [row, pos, self.of_byte[np.frombuffer(raw, np.uint8)]], ("word", "pos", "id"))
        out = self.db.execute(self.merge_long if long else MERGE).fetchnumpy()
        tokens = np.bincount(out["word"], minlength=len(words))
        self._keep(np.array([p for p, _ in words]), np.asarray(out["id"], np.int32), tokens)

    def _keep(self, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the words at ``places``, one word after another, ``sizes`` of each."""
        end = self.used + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.words) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        self.flat[self.used : end] = ids
        self.starts[places], self.sizes[places] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used = end

    def decode(self, lists: pa.ListArray) -> list[bytes | None]:
        """Bytes of every list; None for a list with a null or an id that the file lacks."""
        offsets, values = lists.offsets.to_numpy(), lists.values
        parts: list[list[bytes] | None] = [[] for _ in range(len(lists))]
        for at in range(int(offsets[0]), int(offsets[-1]), SLICE):
            end = min(at + SLICE, int(offsets[-1]))
            pos = np.arange(at, end)
            row = np.searchsorted(offsets, pos, "right") - 1
            self.db.register("coded", pa.table({"row": row, "pos": pos, "id": values.slice(at, end - at)}))
            for number, shown, unknown in self.db.execute(DECODE).fetchall():
                if unknown:
                    parts[number] = None
                elif parts[number] is not None:
                    parts[number].append(shown.encode("latin-1"))
            self.db.unregister("coded")
        return [None if p is None else b"".join(p) for p in parts]


def _merger(path: str, pattern: str, together: bool) -> Merger:
    return kept(f"{path} {together} {pattern}", lambda: Merger(path, pattern, together))


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every whole text, as the tiktoken library's ``encode_ordinary`` gives them.

    ``ranks`` is the path of a rank file on every executor. ``pattern`` splits a text into words, which are encoded apart;
    its matches must not run from another character into white space. A word that is a token is that token. Of other
    words each task contracts the leftmost pair of least rank, over and over, by a recursive DuckDB query over rows of
    (word, position, id), for all its new words together; words seen are kept in a bounded memory. Nothing is shuffled.

    A null or empty text has no ids; repeated rows are encoded again; an empty table gives no rows; null keys are kept;
    further columns are not read. Memory follows the longest text and, a hundred times its bytes, the longest word.
    """
    kind = docs.schema[key].dataType.simpleString()
    together = merges_in_order(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _merger(ranks, pattern, together).encode([t or "" for t in b["text"].to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b["key"], pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], ["key", "ids"])

    named = f"{ranks} {together} {pattern}"
    return arrow_map(docs, {"key": key, "text": text}, work, f"key {kind}, ids array<int>", named).withColumnRenamed("key", key)


def decode(coded: DataFrame, ranks: str, pattern: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and ``decoded`` (binary): the ids' bytes, joined to the vocabulary and aggregated in their order.

    An empty or null list gives no bytes; a list with a null or an unknown id gives null; other rows as :func:`encode`.
    """
    together = merges_in_order(ranks)
    names = {f"keep_{i}": c for i, c in enumerate(keep)}
    types = ", ".join(f"{k} {coded.schema[c].dataType.simpleString()}" for k, c in names.items())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["ids"]
            if lists.null_count:  # a null list may stand over values
                lists = pa.array(lists.to_pylist(), lists.type).fill_null([])
            found = _merger(ranks, pattern, together).decode(lists)
            yield pa.RecordBatch.from_arrays([*[b[k] for k in names], pa.array(found, pa.binary())], [*names, "decoded"])

    out = arrow_map(coded, {**names, "ids": ids}, work, f"{types}, decoded binary", f"{ranks} {together} {pattern}")
    return out.select(*[F.col(k).alias(c) for k, c in names.items()], "decoded")
