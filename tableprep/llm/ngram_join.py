"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of word shingles ("tokens"). A global order puts tokens from rare to frequent. Rare tokens index a
set by themselves, frequent ones in combinations of two, and the prefix of a set is extended until its partners must
share an indexed token or combination with it. Candidates are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tableprep.llm.components import connected_components
from tableprep.llm.text import arrow_map, spaced_words, utf8
from tableprep.plans.scratch import free_shuffles, materialize

U = np.uint64
# Tokens are 56-bit hashes: two shingles of one pair of documents of a thousand words meet by chance once in 10^11.
BITS = 56
FOLD = 8
VERIFIED = "a bigint, b bigint, size_a bigint, size_b bigint, both bigint, gap array<bigint>"
BLOCK_TOKENS, BLOCK_SETS = 600_000, 60_000
RANGE_TOKENS = 700_000


class WordKeys(dict):
    """64-bit keys of words; emptied when it holds ``most`` of them."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = key = xxhash.xxh3_64_intdigest(word)
        return key


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def shingle_set(words: list[bytes], size: int, keys: WordKeys) -> np.ndarray:
    """Sorted distinct tokens of the windows of ``size`` words; of fewer words, one token for the whole sequence."""
    if not words:
        return np.zeros(0, U)
    ids = np.fromiter(map(keys.__getitem__, words), U, len(words))
    size = min(size, len(ids))
    h = np.full(len(ids) - size + 1, size, U)
    for k in range(size):
        h = h * U(0x9E3779B97F4A7C15) + ids[k : len(ids) - size + 1 + k]
    return np.unique(mixed(h) >> U(64 - BITS))


def _narrow(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    return (tokens >> U(BITS - 32)) * U(ranges) >> U(32)


class Block:
    """Some consecutive documents of a task: their distinct sets and which document has which."""

    def __init__(self, number: int):
        self.number, self.places, self.sets = number, {}, []
        self.ids, self.sizes, self.digests, self.of = [], [], [], []
        self.tokens = 0

    def add(self, key, tokens: np.ndarray) -> None:
        digest = xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None
        place = self.places.get(digest)
        if place is None and digest is not None:
            place = self.places[digest] = len(self.sets)
            self.sets.append(tokens)
            self.tokens += len(tokens)
        for column, value in zip((self.ids, self.sizes, self.digests, self.of), (key, len(tokens), digest, place)):
            column.append(value)

    def full(self) -> bool:
        return self.tokens >= BLOCK_TOKENS or len(self.sets) >= BLOCK_SETS

    def rows(self, ranges: int) -> Iterator[dict]:
        """The documents, and for each range of tokens those of the block with the place of their set."""
        yield {"dest": self.number % ranges, "block": self.number, "ids": self.ids, "sizes": self.sizes, "digests": self.digests, "of": self.of}
        if not self.sets:
            return
        tokens = np.concatenate(self.sets)
        places = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets]).astype("<u2")
        order = np.argsort(tokens, kind="stable")
        tokens, places = tokens[order], places[order]
        where = _range_of(tokens, ranges)
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(tokens)]):
            high, counts = np.unique(tokens[a:b] >> U(40), return_counts=True)
            yield {
                "dest": int(where[a]), "block": self.number, "high": high.astype("<u2").tobytes(), "counts": counts.astype("<u4").tobytes(),
                "low": _narrow(tokens[a:b], 5), "places": places[a:b].tobytes(),
            }


def _block_fields(kind: str) -> str:
    return f"dest bigint, block bigint, ids array<{kind}>, sizes array<bigint>, digests array<binary>, of array<int>"


def _arrow_fields(kind: pa.DataType) -> dict[str, pa.DataType]:
    return {
        "dest": pa.int64(), "block": pa.int64(), "ids": pa.list_(kind), "sizes": pa.list_(pa.int64()), "digests": pa.list_(pa.binary()),
        "of": pa.list_(pa.int32()),
    }


def _sent(size: int, ranges: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count = WordKeys(), TaskContext.get().partitionId() << 32
        block = Block(count)
        schema = None
        for b in batches:
            schema = pa.schema(_arrow_fields(b["id"].type) | {c: pa.binary() for c in ("high", "counts", "low", "places")})
            for key, text in zip(b["id"].to_pylist(), utf8(b["text"])):
                block.add(key, shingle_set(spaced_words(text), size, keys))
                if block.full():
                    yield from _rows(block, ranges, schema)
                    count += 1
                    block = Block(count)
        if block.ids:
            yield from _rows(block, ranges, schema)

    return work


def _rows(block: Block, ranges: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting: list[dict] = []
    for row in block.rows(ranges):
        waiting.append(row)
        if len(waiting) == 256:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting = []
    yield pa.RecordBatch.from_pylist(waiting, schema)


def _counted(table: pa.Table) -> pa.Table:
    """Of one range: the tokens that two sets or more hold, with that number, back to each block."""
    sent = table.filter(pa.compute.is_valid(table["low"]))
    kept = table.filter(pa.compute.is_null(table["low"])).drop_columns(["high", "counts", "low", "places"])
    empty = {c: pa.nulls(kept.num_rows, pa.binary()) for c in ("tokens", "places", "counts")}
    for c, v in empty.items():
        kept = kept.append_column(c, v)
    if not sent.num_rows:
        return kept
    parts, sizes = [], []
    for high, counts, low in zip(sent["high"].to_pylist(), sent["counts"].to_pylist(), sent["low"].to_pylist()):
        tokens = _wide(low, 5) | np.repeat(np.frombuffer(high, "<u2").astype(U) << U(40), np.frombuffer(counts, "<u4"))
        parts.append(tokens)
        sizes.append(len(tokens))
    tokens = np.concatenate(parts)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    held = np.empty(len(tokens), np.int64)
    held[order] = np.repeat(np.diff(np.r_[starts, len(tokens)]), np.diff(np.r_[starts, len(tokens)]))
    rows, at = [], 0
    for block, places, n in zip(sent["block"].to_pylist(), sent["places"].to_pylist(), sizes):
        common = held[at : at + n] > 1
        if common.any():
            rows.append({
                "block": block, "tokens": _narrow(tokens[at : at + n][common], 7), "places": np.frombuffer(places, "<u2")[common].tobytes(),
                "counts": np.minimum(held[at : at + n][common], 65535).astype("<u2").tobytes(),
            })
        at += n
    back = pa.Table.from_pylist(rows, kept.schema)
    return pa.concat_tables([kept, back])


SETS = "size bigint, digest binary, rare bigint, weight bigint, tokens binary, counts binary"


def _gathered(keep: int, of: int):
    """Of one block: its documents; a set that may have a partner also gets its common tokens, rare ones first."""

    def work(table: pa.Table) -> pa.Table:
        sent = table.filter(pa.compute.is_valid(table["tokens"]))
        tokens = np.concatenate([np.zeros(0, U), *[_wide(t, 7) for t in sent["tokens"].to_pylist()]])
        places = np.concatenate([np.zeros(0, "<u2"), *[np.frombuffer(p, "<u2") for p in sent["places"].to_pylist()]])
        counts = np.concatenate([np.zeros(0, "<u2"), *[np.frombuffer(c, "<u2") for c in sent["counts"].to_pylist()]])
        order = np.lexsort((tokens, counts, places))
        tokens, places, counts = tokens[order], places[order], counts[order]
        out: list[dict] = []
        for row in table.filter(pa.compute.is_valid(table["ids"])).to_pylist():
            shown: set[int] = set()
            for key, size, digest, place in zip(row["ids"], row["sizes"], row["digests"], row["of"]):
                new = {"id": key, "size": size, "digest": digest}
                if place is not None and place not in shown:
                    shown.add(place)
                    a, b = np.searchsorted(places, [place, place + 1])
                    new["rare"] = size - int(b - a)
                    # A partner leaves at most size - ceil(keep / of * size) tokens of this set out.
                    if of * new["rare"] <= (of - keep) * size:
                        weight = 1000 * (int(counts[a:b].sum(dtype=np.int64)) + new["rare"]) // size
                        new |= {"weight": weight, "tokens": tokens[a:b].tobytes(), "counts": counts[a:b].tobytes()}
                out.append(new)
        kind = table.schema.field("ids").type.value_type
        names = {"id": kind, "size": pa.int64(), "digest": pa.binary(), "rare": pa.int64(), "weight": pa.int64(), "tokens": pa.binary(), "counts": pa.binary()}
        return pa.Table.from_pylist(out, pa.schema(names))

    return work


def signatures(size: int, rare: int, tokens: np.ndarray, counts: np.ndarray, frequent: int, keep: int, of: int) -> np.ndarray:
    """Keys under which a set is indexed.

    With ``m`` tokens at most left out by a partner, a prefix guarantees a shared key if leaving out ``m`` of its tokens
    cannot destroy all keys: a single token is destroyed by leaving it out, the pairs of ``g`` tokens only by leaving
    out ``g - 1``. Frequent tokens are dealt into classes by their hash, as many as an eighth of the smallest size of
    the size class, so pairs stay few; tokens are taken, rare ones first, until the sum passes ``m``. Tokens that no
    other set holds count but need no key. Keys belong to a size class (powers of two), and a set whose partners may be
    in the class below is indexed there too.
    """
    missing = size * (of - keep) // of
    level = size.bit_length() - 1
    out = []
    for lev in (level, level - 1):
        if lev < 0 or (lev < level and keep * size > of * ((1 << level) - 1)):
            continue
        classes = max(1, (1 << lev) // 8)
        single = counts <= frequent
        group = np.where(single, -1, (tokens % U(classes)).astype(np.int64))
        # What each further token adds: a single one 1, the first of a class 0, the others 1.
        fresh = np.zeros(len(tokens), bool)
        fresh[np.unique(group, return_index=True)[1]] = True
        adds = np.where(single | ~fresh, 1, 0)
        need = missing + 1 - rare
        if need <= 0:
            continue
        end = int(np.searchsorted(np.cumsum(adds), need)) + 1
        head, group = tokens[:end], group[:end]
        seed = U((lev + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        out.append(mixed(head[group < 0] + seed))
        many = np.flatnonzero(group >= 0)
        many = many[np.lexsort((head[many], group[many]))]
        for step in range(1, len(many)):
            same = group[many[:-step]] == group[many[step:]]
            if not same.any():
                break
            a, b = head[many[:-step]][same], head[many[step:]][same]
            out.append(mixed(mixed(a + seed) * U(3) + mixed(b + seed)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def _indexed(frequent: int, keep: int, of: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                cells: list[list[np.ndarray]] = [[], [], [], [], []]
                rows = b.slice(start, 500).to_pylist()
                for r in rows:
                    counts = np.frombuffer(r["counts"], "<u2")
                    keys = signatures(r["size"], r["rare"], np.frombuffer(r["tokens"], "<u8"), counts, frequent, keep, of)
                    for column, value in zip(cells, (keys.view(np.int64), r["weight"], r["node"], r["size"], r["size"] - r["rare"])):
                        column.append(value if isinstance(value, np.ndarray) else np.full(len(keys), value, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cells], ["key", "weight", "node", "size", "common"])

    return work


def folded(tokens: np.ndarray) -> list[int]:
    """Bits of the tokens in ``FOLD`` words of 64: no more bits than tokens."""
    out = np.zeros(FOLD, U)
    np.bitwise_or.at(out, (tokens >> U(6)) % U(FOLD), U(1) << (tokens & U(63)))
    return out.view(np.int64).tolist()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both, gaps = [], []
        for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist()):
            x = np.frombuffer(x, "<u8")
            common = np.intersect1d(x, np.frombuffer(y, "<u8"), assume_unique=True)
            both.append(len(common))
            gaps.append(folded(np.setdiff1d(x, common, assume_unique=True)))
        cells = [b["a"], b["b"], b["size_a"], b["size_b"], pa.array(both, pa.int64()), pa.array(gaps, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cells, ["a", "b", "size_a", "size_b", "both", "gap"])


def _similar(both: Column | str, keep: int, of: int) -> Column:
    """Whether so large an overlap makes two sets of ``size_a`` and ``size_b`` tokens similar enough."""
    return (keep + of) * (F.col(both) if isinstance(both, str) else both) >= keep * (F.col("size_a") + F.col("size_b"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their exact overlap ``both`` and the folded common tokens of a that b lacks, ``gap``."""
    side = lambda node, name, size: sets.select(F.col("node").alias(node), F.col("tokens").alias(name), F.col("size").alias(size))
    joined = pairs.select("a", "b").join(side("a", "x", "size_a"), "a").join(side("b", "y", "size_b"), "b")
    return arrow_map(joined, {c: c for c in ("a", "b", "x", "y", "size_a", "size_b")}, _overlaps, VERIFIED)


def _main_labels(labelled: DataFrame, key: str) -> DataFrame:
    """(key, main) of the keys that hold several labels: the one of most rows."""
    by_label = labelled.groupBy(key, "label").agg(F.count("*").alias("n"))
    mains = by_label.groupBy(key).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"))
    return mains.filter("labels > 1").select(key, "main")


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Written and read back; the shuffles that made it may go."""
    out = materialize(df, label)
    free_shuffles(df.sparkSession)
    return out


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, keep: int = 75, of: int = 100, frequent: int = 32
) -> DataFrame:
    """Per document: ``key``, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    Two documents link when the Jaccard similarity of their shingle sets is at least ``keep / of``. ``frequent``: a
    token held by more sets is indexed in combinations of two.

    1. Each task turns its documents into blocks of distinct sets, deals the tokens of a block over ranges of tokens in
       packed form, and each range sends back the tokens that two or more sets hold, with that number. A set with too
       many tokens of its own cannot have a partner and leaves. A block holds a set once, whatever its copies.
    2. Sets are indexed by :func:`signatures`. In each list of an index key, all sets are verified against the one whose
       tokens are the most widely held, most often the text that the others were made from: a star instead of all
       pairs. Components are formed.
    3. Lists that still hold several components: the sets outside the largest component are verified against those of
       other components. Pairs inside a component are never formed, and no possible link between components is left
       out, but most pairs that cannot link are ruled out by what is known of either set's overlap with a common third
       set c: ``|x & y| <= min(|x & c|, |y & c|, |c| - |c - x - y|) + min(|x - c|, |y - c|)``. Sets verified against
       the same most widely held set meet there once, others in their lists.

    Null and empty texts have no shingles and are linked with nothing: their component is their own key. Equal texts
    are linked. A null key takes part, but a component takes the smallest key that is not null. Repeated rows each
    give a row; empty tables give no rows; further columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    ranges = 1 + size // (6 * RANGE_TOKENS)
    blocks = _block_fields(kind)
    sent = arrow_map(docs, {"id": key, "text": text}, _sent(shingle, ranges), f"{blocks}, high binary, counts binary, low binary, places binary")
    counted = sent.groupBy("dest").applyInArrow(_counted, f"{blocks}, tokens binary, places binary, counts binary")
    gathered = counted.groupBy("block").applyInArrow(_gathered(keep, of), f"id {kind}, {SETS}")
    members = materialize(gathered, "sets")
    del sent, counted, gathered
    free_shuffles(spark)

    sets = _stored(
        members.filter("tokens is not null").groupBy("digest").agg(F.first(F.struct("size", "rare", "weight", "tokens", "counts")).alias("s"))
        .select("digest", "s.*").withColumn("node", F.monotonically_increasing_id()),
        "candidates",
    )
    columns = ("node", "size", "rare", "weight", "tokens", "counts")
    fields = "key bigint, weight bigint, node bigint, size bigint, common bigint"
    index = materialize(arrow_map(sets, {c: c for c in columns}, _indexed(frequent, keep, of), fields), "index")
    heads = index.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("weight", "node")).alias("head")).filter("n > 1")
    heads = heads.select("key", F.col("head.node").alias("a"))
    lists = _stored(index.drop("weight").join(heads, "key"), "lists")
    star = lists.select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    star = _stored(_verified(star, sets), "star")
    links = star.filter(_similar("both", keep, of)).select("a", "b")
    labels = connected_components(links)

    labelled = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = _main_labels(labelled, "key")
    # What is known of each set: the most widely held set that it was verified against (or itself), and the overlap.
    facts = sets.select("node", "size", "weight", (F.col("size") - F.col("rare")).alias("common"))
    centre = facts.select(F.col("node").alias("a"), "weight", F.col("common").alias("centre_common"))
    met = star.select("a", F.col("b").alias("node"), "both", "gap").join(centre, "a")
    alone = centre.join(star.select("a").distinct(), "a", "left_semi").select(
        "a", F.col("a").alias("node"), F.col("centre_common").alias("both"), F.array(*[F.lit(0).cast("bigint")] * FOLD).alias("gap"), "weight", "centre_common"
    )
    met = met.unionByName(alone).groupBy("node").agg(F.max_by(F.struct(F.col("a").alias("centre"), "both", "gap", "centre_common"), F.struct("weight", "a")).alias("m"))
    known = met.select("node", "m.*").join(facts.select("node", "size", "common"), "node").join(labels, "node", "left")
    known = known.withColumns({"label": F.coalesce("label", "node"), "far": F.col("common") - F.col("both")})
    known = _stored(known.select("node", "centre", "centre_common", "label", "size", F.col("both").alias("near"), "far", "gap"), "known")
    side = lambda df, end: df.select(*[F.col(c).alias(f"{c}_{end}") for c in df.columns if c not in ("key", "main", "node")], *[c for c in df.columns if c in ("key", "main")], F.col("node").alias(end))
    apart = "label_a <> label_b and (label_b = main or a < b)"

    round_centre = known.withColumnRenamed("centre", "key").join(_main_labels(known.withColumnRenamed("centre", "key"), "key"), "key")
    lacking = sum((F.bit_count(F.col("gap_a")[i].bitwiseOR(F.col("gap_b")[i])) for i in range(1, FOLD)), F.bit_count(F.col("gap_a")[0].bitwiseOR(F.col("gap_b")[0])))
    most = F.least("near_a", "near_b", F.col("centre_common_a") - lacking) + F.least("far_a", "far_b")
    same_centre = (
        side(round_centre.filter("label <> main").drop("main"), "a").join(side(round_centre, "b"), "key")
        .filter(apart).filter(_similar(most, keep, of)).select("a", "b")
    )

    by_head = star.select("a", F.col("b").alias("node"), "both")
    rows = labelled.join(several, "key").join(by_head, ["a", "node"], "left").join(known.select("node", "centre"), "node")
    inside = F.coalesce("both", "common")
    rows = _stored(rows.select("key", "main", "label", "node", "size", "centre", inside.alias("inside"), (F.col("common") - inside).alias("outside")), "several")
    most = F.least("inside_a", "inside_b") + F.least("outside_a", "outside_b")
    other_centre = (
        side(rows.filter("label <> main").drop("main"), "a").join(side(rows, "b"), "key")
        .filter(apart).filter("centre_a <> centre_b").filter(_similar(most, keep, of)).select("a", "b")
    )
    rest = same_centre.unionByName(other_centre).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = _stored(rest.distinct(), "pairs")
    more = _verified(rest, sets).filter(_similar("both", keep, of)).select("a", "b")
    labels = connected_components(links.unionByName(more))

    of_set = members.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("first"))
    named = sets.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    group = of_set.join(named, "digest", "left").select("digest", "first", F.coalesce(F.col("label").cast("string"), F.hex("digest")).alias("label"))
    group = materialize(group, "classes")
    lowest = group.groupBy("label").agg(F.min("first").alias("component_id"))
    component = group.join(lowest, "label").select("digest", "component_id")
    return members.join(component, "digest", "left").select(
        F.col("id").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component_id", F.col("id")).alias("component_id")
    )
