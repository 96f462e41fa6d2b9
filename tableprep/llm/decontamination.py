"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tableprep.llm.text import arrow_map, batch, kept, plain_words, utf8
from tableprep.plans.scratch import materialize

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# Code of a word that no item has.
UNKNOWN = "\0\0"
# Words of a piece of a long item.
PIECE = 2_048
SPAN = "array<struct<start:bigint,end:bigint>>"
SCAN = f"text string, spots {SPAN}, items array<string>"
RESULT = f"n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans {SPAN}"


class WindowAutomaton:
    """Aho-Corasick automaton over coded words of all windows of ``size`` words of the given texts.

    A word is two symbols, the digits of its number to a base near the square root of the vocabulary: a window has few
    nodes, and no node, the root included, more than some hundreds of children, which the automaton searches one by one.
    First and second digits differ, so a match cannot begin inside a word. A window's number leads to its length and to
    the texts that hold it; nearly all have one text, which is a number in an array, so only shared windows cost a list.
    """

    def __init__(self, items: list[tuple[list[str], list[bytes]]], size: int):
        vocabulary = sorted({w for _, words in items for w in words})
        base = math.isqrt(len(vocabulary)) + 1
        self.codes = {w: chr(1 + i // base) + chr(1 + base + 1 + i % base) for i, w in enumerate(vocabulary)}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.lengths, self.first, self.more = array("L"), array("L"), {}
        self.ids = [ids for ids, _ in items]
        for text, (_, words) in enumerate(items):
            coded = "".join([self.codes[w] for w in words])
            for i in range(max(1, len(words) - size + 1) if words else 0):
                self._add(coded[2 * i : 2 * (i + size)], text)
        if len(self.trie):
            self.trie.make_automaton()

    def _add(self, window: str, text: int) -> None:
        number = self.trie.get(window, -1)
        if number < 0:
            self.trie.add_word(window, len(self.first))
            self.lengths.append(len(window) // 2)
            self.first.append(text)
        elif self.first[number] != text and self.more.setdefault(number, [self.first[number]])[-1] != text:
            self.more[number].append(text)

    def get_stats(self) -> dict[str, int]:
        """The trie's figures; ``total_size`` with the codes of words and the arrays of windows, in bytes."""
        words = sum(len(w) + 160 for w in self.codes)
        stats = self.trie.get_stats()
        return {**stats, "total_size": stats["total_size"] + words + 16 * len(self.first) + 120 * len(self.more)}


def build(items: list[tuple[str | list[str] | None, bytes]], size: int) -> WindowAutomaton:
    """Automaton of the windows of ``size`` words of all texts, each with its item id or list of ids."""
    listed = lambda ids: ids if isinstance(ids, list) else [] if ids is None else [ids]
    return WindowAutomaton([(listed(ids), plain_words(text)) for ids, text in items], size)


def occurrences(automaton: WindowAutomaton, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
    """Merged word ranges that windows cover, and the ids of the items found."""
    merged: list[list[int]] = []
    if not words or not len(automaton.trie):
        return merged, set()
    code, lengths, seen = automaton.codes.get, automaton.lengths, set()
    for last, number in automaton.trie.iter("".join([code(w, UNKNOWN) for w in words])):
        seen.add(number)
        # Matches arrive by their end; a longer one may reach back over earlier ranges.
        end = (last + 1) // 2
        start = end - lengths[number]
        while merged and merged[-1][1] >= start:
            start = min(start, merged.pop()[0])
        merged.append([start, end])
    texts = {automaton.first[n] for n in seen}.union(*[automaton.more[n] for n in seen if n in automaton.more])
    return merged, {item for t in texts for item in automaton.ids[t]}


def item_pieces(items: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """Distinct word sequences of the items, each with the ids of its items (``ids``, ``words``).

    A long item becomes pieces of ``PIECE`` words that overlap by ``window`` - 1 words, so that each of its windows lies in
    exactly one piece; equal items, however many, are one row.
    """
    step = max(PIECE, window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pieces = [], []
            for item, text in zip(b["item"].to_pylist(), utf8(b["text"])):
                words = plain_words(text)
                for at in range(0, max(1, len(words) - window + 1) if words else 0, step):
                    ids.append(item)
                    pieces.append(b" ".join(words[at : at + step + window - 1]).decode())
            yield batch(item=pa.array(ids, pa.string()), words=pa.array(pieces, pa.string()))

    columns = {"item": F.col(f"`{item_id}`").cast("string"), "text": F.col(f"`{item_text}`")}
    # collect_set leaves out the missing ids, whose pieces stay.
    return arrow_map(items, columns, work, "item string, words string").groupBy("words").agg(F.collect_set("item").alias("ids"))


def original_spans(text: str, ranges: list[list[int]]) -> list[dict[str, int]]:
    """Ranges of words as offsets into the text as it was, in code points."""
    if not ranges:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in ranges]


def _merge(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_contamination(
    docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, automaton_bytes: int = 3 << 20,
) -> DataFrame:
    """Per document (columns ``keep``): words, words inside any occurrence of an item's window, items found, spans.

    A window is ``window`` consecutive words of an item; a shorter item is one window. Equal items are sent once, with all
    their ids, long ones in overlapping pieces, so that no item is a whole part by itself. The automaton takes two steps for a
    word and some 150 bytes of memory for each of the item texts; up to ``automaton_bytes`` of text there is one automaton
    and one pass over the texts, which stores no text. Beyond, parts of that size are scanned in turn, the result stored
    between them, so that a worker never has the automata of two parts. No text is shuffled.

    Null and empty texts have no words and hit nothing; null and empty items have no window; an item without an id
    marks words but is not listed; repeated items count once; repeated documents each give a row; no items or no
    documents give no hits or no rows. Columns of ``docs`` besides ``keep`` and ``text`` are not read.
    """
    spark = docs.sparkSession
    pieces = materialize(item_pieces(items, item_id, item_text, window), "items")
    size = F.octet_length("words") + F.aggregate("ids", F.lit(0), lambda n, x: n + F.octet_length(x))
    total = pieces.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    parts = max(1, -(-total // automaton_bytes))
    columns = {f"keep_{i}": c for i, c in enumerate(keep)}
    kept = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()], F.col(f"`{text}`").alias("text"))
    types = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in columns)
    out = kept.withColumns({"spots": F.lit(None).cast(SPAN), "items": F.lit(None).cast("array<string>")})
    for part in range(parts):
        if part:
            out = materialize(out, "scanned")
        share = pieces.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == part).collect()
        sent = spark.sparkContext.broadcast([(list(r["ids"]), r["words"].encode()) for r in share])
        last = part == parts - 1
        schema = f"{types}, {RESULT if last else SCAN}"
        name = uuid.uuid4().hex
        out = arrow_map(out, {c: c for c in out.columns}, _scanner(sent, list(columns), window, last, name), schema, name)
    return out.withColumnsRenamed(columns)


def _scanner(sent, columns: list[str], window: int, last: bool, name: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept(name, lambda: build(sent.value, window))
        for b in batches:
            rows = []
            for raw, spots, before in zip(utf8(b["text"]), b["spots"].to_pylist(), b["items"].to_pylist()):
                words = plain_words(raw)
                ranges, found = occurrences(automaton, words)
                if spots or before:
                    ranges = _merge(ranges + [[s["start"], s["end"]] for s in spots or []])
                    found.update(before or [])
                rows.append((raw, len(words), ranges, sorted(found)))
            cells = [b[c] for c in columns]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            lists = pa.array([r[3] for r in rows], pa.list_(pa.string()))
            if not last:
                spots = pa.array([[{"start": s, "end": e} for s, e in r[2]] for r in rows], span)
                yield pa.RecordBatch.from_arrays([*cells, b["text"], spots, lists], [*columns, "text", "spots", "items"])
                continue
            hits = [sum(e - s for s, e in r[2]) for r in rows]
            new = {
                "n_words": pa.array([r[1] for r in rows], pa.int64()),
                "n_hit": pa.array(hits, pa.int64()),
                "n_items": pa.array([len(r[3]) for r in rows], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(r[3]).encode()).hexdigest() for r in rows], pa.string()),
                "contaminated": pa.array([h > 0 for h in hits], pa.bool_()),
                "items": lists,
                "spans": pa.array([original_spans(r[0].decode("utf-8", "replace"), r[2]) for r in rows], span),
            }
            yield pa.RecordBatch.from_arrays([*cells, *new.values()], [*columns, *new])

    return work
