"""Hidden Markov language model: Baum-Welch counts summed over partitions, likelihoods by the scaled forward recursion.

Symbols: the most frequent words have an emission of their own; every other word is emitted through the class of its
ending, times its share of the class by its exact count over the corpus. So the model's size is bounded while the
counts that it scores with cover all words.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tableprep.llm.text import arrow_map, held_out, kept, spaced_words, utf8
from tableprep.plans.scratch import materialize

END = b"\n"  # no word holds white space
RARE = 0.1  # added to each count
HOT_BYTES = 64  # longest word sent to the executors


@dataclass(frozen=True)
class Settings:
    """``hot`` words at most are sent to the executors with their counts, ``own`` of them have their own emission."""

    states: int = 8
    own: int = 16_384
    classes: int = 4_096
    hot: int = 1 << 18
    rounds: int = 3
    seeds: int = 256
    segment: int = 512
    prior: float = 20.0


def ending_class(word: bytes, classes: int) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % classes


class Places(dict):
    """Place of a word among the hot ones; any other word has the place of its class after them."""

    def __init__(self, words: list[bytes], classes: int):
        super().__init__((w, i) for i, w in enumerate(words))
        self.hot, self.classes, self.endings = len(words), classes, {}

    def __missing__(self, word: bytes) -> int:
        end = word[-3:]
        place = self.endings.get(end)
        if place is None:
            if len(self.endings) > 200_000:
                self.endings.clear()
            place = self.endings[end] = self.hot + ending_class(word, self.classes)
        return place

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class Vocabulary:
    """Hot words by falling count with what each place stands for; arrays cover hot words, then classes."""

    name: str
    words: list[bytes]
    symbol: np.ndarray
    base: np.ndarray  # log10 of the smoothed count; 0 for classes, whose words are looked up
    share: np.ndarray  # log10 of the word's share of its symbol; for classes, of the class total alone
    spread: np.ndarray  # probability of each symbol
    classes: int
    total: float
    known: int


def places_of(v: Vocabulary) -> Places:
    return kept(v.name, lambda: Places(v.words, v.classes))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()
    for b in batches:
        for text in utf8(b["text"]):
            found.update(spaced_words(text))
            found[END] += 1
            if len(found) > 300_000:
                yield _pairs(found)
                found.clear()
    yield _pairs(found)


def _pairs(found: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all tokens of ``docs``, pre-aggregated in each task; one end for each text."""
    return arrow_map(docs, {"text": text}, _counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def vocabulary(counts: DataFrame, settings: Settings) -> Vocabulary:
    spark = counts.sparkSession
    sums = counts.agg(F.count("*").alias("known"), F.sum("c").alias("total")).first()
    known, total = sums["known"], sums["total"] or 0
    hot = counts.filter(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("c"), "word").limit(settings.hot).toArrow()
    words, c = hot["word"].to_pylist(), hot["c"].to_numpy().astype(float)
    own, classes = min(settings.own, len(words)), settings.classes
    taken = spark.sparkContext.broadcast(set(words[:own]))

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(classes)
        for b in batches:
            for word, n in zip(b["word"].to_pylist(), b["c"].to_pylist()):
                if word not in taken.value:
                    sums[ending_class(word, classes)] += n + RARE
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["class", "s"])

    rows = arrow_map(counts, {"word": "word", "c": "c"}, tied, "class bigint, s double").groupBy("class").agg(F.sum("s").alias("s")).collect()
    of_class = np.full(classes, RARE)  # each class also holds its unknown words
    for r in rows:
        of_class[r["class"]] += r["s"]
    ending = np.array([ending_class(w, classes) for w in words[own:]], int)
    symbol = np.concatenate([np.arange(own), own + ending, own + np.arange(classes)])
    base = np.concatenate([np.log10(c + RARE), np.zeros(classes)])
    share = np.concatenate([np.zeros(own), np.log10(c[own:] + RARE) - np.log10(of_class[ending]), -np.log10(of_class)])
    spread = np.concatenate([c[:own] + RARE, of_class])
    return Vocabulary(uuid.uuid4().hex, words, symbol, base, share, spread / spread.sum(), classes, float(total), known)


@dataclass
class Model:
    start: np.ndarray
    occupied: np.ndarray  # share of time in each state
    move: np.ndarray
    emit: np.ndarray  # symbols x states


class Packed:
    """Sequences side by side in order of time: at each step those that go on, longest first, in one slice."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        longest = int(sizes.max())
        self.active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), "right")
        self.off = np.concatenate([[0], np.cumsum(self.active)])
        first = np.cumsum(sizes) - sizes
        step = np.arange(len(flat)) - np.repeat(first, sizes)
        self.place = self.off[step] + np.repeat(rank, sizes)
        self.symbols = np.empty_like(flat)
        self.symbols[self.place] = flat
        self.order, self.first = order, first

    def forward(self, model: Model, begins: np.ndarray | None = None, states: np.ndarray | None = None) -> np.ndarray:
        """Scale of each step; their product over a sequence is its likelihood. ``states``: gets the scaled forward values."""
        scales = np.empty(len(self.symbols))
        a = np.empty((0, 0))
        for t, n in enumerate(self.active):
            at = slice(self.off[t], self.off[t] + n)
            if t:
                a = a[:n] @ model.move
            else:
                a = model.start if begins is None else np.where(begins[self.order, None], model.start, model.occupied)
            a = a * model.emit[self.symbols[at]]
            scales[at] = s = a.sum(axis=1)
            a /= s[:, None]
            if states is not None:
                states[at] = a
        return scales

    def log_likelihoods(self, model: Model) -> np.ndarray:
        return np.add.reduceat(np.log10(self.forward(model))[self.place], self.first)

    def expected(self, model: Model, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions: one forward and one backward pass."""
        k = len(model.start)
        states = np.empty((len(self.symbols), k))
        scales = self.forward(model, begins, states)
        moves = np.zeros((k, k))
        after = np.ones((0, k))
        for t in range(len(self.active) - 1, -1, -1):
            n, m = self.active[t], len(after)
            at = slice(self.off[t], self.off[t] + n)
            beta = np.ones((n, k))
            if m:
                moves += states[self.off[t] : self.off[t] + m].T @ after
                beta[:m] = after @ model.move.T
            now = states[at]
            after = model.emit[self.symbols[at]] * beta / scales[at][:, None]
            now *= beta
        starts = states[: self.active[0]][begins[self.order]].sum(axis=0)
        emissions = np.stack([np.bincount(self.symbols, states[:, s], len(model.emit)) for s in range(k)], axis=1)
        return starts, moves * model.move, emissions


def cut_segments(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the parts of sequences cut every ``most`` steps, and which parts begin a sequence."""
    parts = -(-sizes // most)
    begins = np.zeros(parts.sum(), bool)
    begins[np.cumsum(parts) - parts] = True
    out = np.full(parts.sum(), most)
    out[np.cumsum(parts) - 1] = sizes - (parts - 1) * most
    return out, begins


CODED = "n_tokens bigint, n_hot bigint, base double, share double, symbols binary, tail array<struct<word:binary,n:bigint>>"


def encode(docs: DataFrame, v: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text once: its symbols as 16-bit numbers, the sums over its hot words and its other words with their number.

    Stored, so that all rounds and the scoring read symbols instead of texts. ``row`` numbers the stored rows.
    """
    if len(v.spread) > 1 << 16:
        raise ValueError("own + classes must be at most 65536")
    sent = docs.sparkSession.sparkContext.broadcast(v)
    kind = docs.schema[key].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        places, hot = places_of(v), len(v.words)
        tail = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for b in batches:
            rows: list[tuple] = []
            for text in utf8(b["text"]):
                words = spaced_words(text)
                words.append(END)
                p = places.of(words)
                other = Counter([words[i] for i in np.flatnonzero(p >= hot)])
                rows.append((
                    len(p), len(p) - other.total(), v.base[p].sum(), v.share[p].sum(), v.symbol[p].astype("<u2").tobytes(),
                    [{"word": w, "n": c} for w, c in other.items()],
                ))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), tail)
            cells = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b["id"], *cells], ["id", "n_tokens", "n_hot", "base", "share", "symbols", "tail"])

    return materialize(arrow_map(docs, {"id": key, "text": text}, coded, f"id {kind}, {CODED}", v.name).withColumn("row", F.monotonically_increasing_id()), "coded")


def symbol_batches(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(symbols, sizes, rows) of whole texts, about ``tokens`` symbols at a time; a text's last symbol is its end."""
    flat, rows, n = [], [], 0
    for b in batches:
        for i, raw in enumerate(b["symbols"].to_pylist()):
            flat.append(np.frombuffer(raw, "<u2"))
            rows.append((b, i))
            n += len(flat[-1])
            if n >= tokens:
                yield np.concatenate(flat), np.array([len(x) for x in flat]), rows
                flat, rows, n = [], [], 0
    if rows:
        yield np.concatenate(flat), np.array([len(x) for x in flat]), rows


def first_model(coded: DataFrame, v: Vocabulary, settings: Settings) -> Model:
    """States from groups of the most frequent words that keep the same company, by their neighbour counts."""
    m, k = min(settings.seeds, settings.own, len(v.words)), settings.states

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(m * m)
        for flat, _, _ in symbol_batches(batches, 400_000):
            a, b = flat[:-1], flat[1:]
            both = (a < m) & (b < m)
            found += np.bincount(a[both].astype(np.int64) * m + b[both], minlength=m * m)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["pair", "n"])

    rows = arrow_map(coded, {"symbols": "symbols"}, neighbours, "pair bigint, n double").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(m * m)
    pairs[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    pairs = pairs.reshape(m, m)
    smooth = pairs + 0.1
    lift = np.log(smooth * smooth.sum() / np.outer(smooth.sum(axis=1), smooth.sum(axis=0)))
    left, strength, right = np.linalg.svd(np.maximum(lift, 0))
    points = np.concatenate([left[:, :k] * np.sqrt(strength[:k]), right[:k].T * np.sqrt(strength[:k])], axis=1)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    centres = [0]
    while len(centres) < min(k, m):  # the point farthest from all chosen ones
        centres.append(int(np.argmin((points @ points[centres].T).max(axis=1))))
    middle = points[centres]
    for _ in range(20):
        group = (points @ middle.T).argmax(axis=1)
        middle = np.stack([points[group == g].sum(axis=0) if (group == g).any() else middle[g] for g in range(len(middle))])
        middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-9)
    emit = np.repeat(v.spread[:, None], k, axis=1)
    emit[:m] *= 0.3
    emit[np.arange(m), group] *= 1 + k * 7 / 3
    member = np.eye(k)[group]
    move = member.T @ pairs @ member
    move = 0.5 * (move + 1) / (move + 1).sum(axis=1, keepdims=True) + 0.5 / k
    even = np.full(k, 1 / k)
    return Model(even, even, move, emit / emit.sum(axis=0))


def baum_welch_round(coded: DataFrame, v: Vocabulary, model: Model, settings: Settings) -> Model:
    """One round over all documents: each task sums its expected counts, Spark sums those of all tasks."""
    k, size = settings.states, len(model.emit)
    shared = coded.sparkSession.sparkContext.broadcast(model)
    names = [f"s{i}" for i in range(k)]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size + k + 1, k))
        for flat, sizes, _ in symbol_batches(batches, 400_000):
            sizes, begins = cut_segments(sizes, settings.segment)
            starts, moves, emissions = Packed(flat, sizes).expected(shared.value, begins)
            sums[:size] += emissions
            sums[size : size + k] += moves
            sums[-1] += starts
        at = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(sums[at, i]) for i in range(k)]], ["row", *names])

    rows = arrow_map(coded, {"symbols": "symbols"}, expect, "row bigint, " + ", ".join(f"{n} double" for n in names))
    rows = rows.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    sums = np.zeros((size + k + 1, k))
    sums[rows["row"].to_numpy()] = np.stack([rows[n].to_numpy() for n in names], axis=1) if len(rows) else sums[:0]
    emissions, moves, starts = sums[:size], sums[size : size + k] + 1, sums[-1] + 1
    occupied = emissions.sum(axis=0) + 1
    emit = emissions + settings.prior * v.spread[:, None]
    return Model(starts / starts.sum(), occupied / occupied.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def fit(coded: DataFrame, v: Vocabulary, settings: Settings = Settings()) -> Model:
    """The model of encoded texts; without training texts, all states are alike."""
    if not v.known:
        k, even = settings.states, np.full(settings.states, 1 / settings.states)
        return Model(even, even, np.full((k, k), 1 / k), np.repeat(v.spread[:, None], k, axis=1))
    model = first_model(coded, v, settings)
    for _ in range(settings.rounds):
        model = baum_welch_round(coded, v, model, settings)
    return model


def score(coded: DataFrame, counts: DataFrame, v: Vocabulary, model: Model) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of encoded texts, in log10.

    The forward recursion runs over whole texts, many at once. Words outside the hot ones are looked up in the stored
    counts by a join; no such word makes up more than 1 in ``hot`` of the corpus, so no key of the join is hot.
    """
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, sizes, rows in symbol_batches(batches, 600_000):
            ll = pa.array(Packed(flat, sizes).log_likelihoods(shared.value))
            cells = {c: [b[c][i] for b, i in rows] for c in ("id", "row", "n_tokens", "n_hot", "base", "share")}
            kinds = rows[0][0].schema
            yield pa.RecordBatch.from_arrays([*[pa.array(v, kinds.field(c).type) for c, v in cells.items()], ll], [*cells, "ll"])

    kind = coded.schema["id"].dataType.simpleString()
    columns = ("id", "row", "n_tokens", "n_hot", "base", "share")
    fields = f"id {kind}, row bigint, n_tokens bigint, n_hot bigint, base double, share double, ll double"
    found = arrow_map(coded, {c: c for c in (*columns, "symbols")}, likely, fields)
    words = coded.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    seen = F.coalesce("c", F.lit(0))
    tails = words.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(seen + RARE)).alias("tail_log"), F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("tail_known")
    )
    log = F.coalesce("tail_log", F.lit(0.0))
    whole = float(np.log10(v.total + RARE * (v.known + 1)))
    return found.join(tails, "row", "left").select(
        "id", "n_tokens", (F.col("n_hot") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        (F.col("base") + log - F.col("n_tokens") * whole).alias("base_score"), (F.col("ll") + F.col("share") + log).alias("score"),
    )


def score_held_out(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int = 10, settings: Settings = Settings()) -> DataFrame:
    """All texts scored by a model of those whose key does not hash into the held-out part.

    ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (unigrams), ``score`` (the
    model). Baum-Welch takes texts in segments of at most ``segment`` tokens, all of them; scoring takes whole texts.

    Null and empty texts are one end; a null key is the text ''; repeated rows count and score each; without training
    texts every token is unknown; no documents give no rows; further columns are not read.
    """
    counts = materialize(word_counts(docs.filter(~held_out(key, parts)), text), "counts")
    v = vocabulary(counts, settings)
    coded = encode(docs, v, key, text)
    model = fit(coded.filter(~held_out("id", parts)), v, settings)
    return score(coded, counts, v, model).select(
        F.col("id").alias(key), held_out("id", parts).alias("held_out"), "n_tokens", "n_known",
        F.lit(int(v.total)).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
