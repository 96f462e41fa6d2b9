import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tableprep.llm import ngram_join, packing
from tableprep.llm.components import connected_components
from tableprep.llm.tokens import WordIds
from tests.llm.conftest import ODD, rows_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def brute_components(rows, keep=75, of=100):
    """(id, text) rows to (number of shingles, smallest id reachable), all pairs compared."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and of * len(sets[a] & sets[b]) >= keep * len(sets[a] | sets[b]):
                group[max(top(a), top(b))] = min(top(a), top(b))
    ids = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[top(i)].append(key)
    return sorted(((key, len(sets[i]), min(ids[top(i)], default=None)) for i, (key, _) in enumerate(rows)), key=str)


def found_components(df, **how):
    return sorted((tuple(r) for r in ngram_join.near_duplicates(df, **how).collect()), key=str)


def test_join_equals_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(small, "documents")]
    assert found_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == brute_components(rows)


@pytest.mark.parametrize("frequent", [1, 32])
def test_join_finds_links_near_the_threshold(spark, frequent):
    """Chains of edited copies, a passage that all share and documents of few words, with every token frequent or none."""
    rng, rows = random.Random(5), []
    passage = [f"p{i}" for i in range(30)]
    for family in range(6):
        words = [f"w{family}_{i}" for i in range(rng.choice([8, 40, 150]))] + passage * (family % 2)
        for _ in range(25):
            words = list(words)
            for _ in range(rng.choice([0, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + i, " ".join(f"t{j}" for j in range(i % 6))) for i in range(18)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert found_components(df, frequent=frequent) == brute_components(rows)


def test_join_odd_rows(odd, nothing):
    assert found_components(odd) == brute_components([(r[0], r[1]) for r in ODD])
    assert found_components(nothing) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.integers(1, 120), st.integers(0, 2**32), st.integers(1, 4))
def test_similar_sets_share_a_signature(n, m, seed, frequent):
    """The guarantee of the extended prefixes: any two sets similar enough have a key in common."""
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 2**56, min(n, m), dtype=np.uint64)
    a = np.unique(np.concatenate([common[: rng.integers(0, len(common) + 1)], rng.integers(0, 2**56, max(0, n - len(common)), dtype=np.uint64)]))
    b = np.unique(np.concatenate([common, rng.integers(0, 2**56, max(0, m - len(common)), dtype=np.uint64)]))
    if not len(a) or not len(b):
        return
    both = np.intersect1d(a, b)
    if 100 * len(both) < 75 * (len(a) + len(b) - len(both)) or len(a) == len(b) == len(both):
        return
    held = {int(t): int(c) for t, c in zip(both, rng.integers(2, 6, len(both)))}

    def keys(x):
        shared = np.array([t for t in x if int(t) in held], np.uint64)
        counts = np.array([held[int(t)] for t in shared], np.uint16)
        order = np.lexsort((shared, counts))
        return set(ngram_join.signatures(len(x), len(x) - len(shared), shared[order], counts[order], frequent, 75, 100).tolist())

    assert keys(a) & keys(b)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    rng.shuffle(links)
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 150)} | {301: 300}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.fixture(scope="module")
def words():
    return WordIds(VOCABULARY, 5_000)


@settings(max_examples=200, deadline=None)
@given(st.text() | st.text(alphabet="aZé'sß·½²:-.,!| \t\n ́İΣ<|endoftext|>0'll"))
def test_word_ids_are_those_of_the_tokenizer(words, text):
    text = text.encode("utf-8", "ignore").decode()
    assert words.encode(text.encode()).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_ids_of_the_documents(words, small):
    for r in rows_of(small, "documents")[:60]:
        assert words.encode(r["text"].encode()).tolist() == words.tokenizer.encode(r["text"], add_special_tokens=False).ids


def check_round_trip(pieces, wanted, tokens=4096):
    """``wanted``: ids of each row; every id in exactly one piece, sequences gapless and within the limit."""
    texts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        ids = np.array(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0 and zlib.crc32(ids.tobytes()) == p["ids_crc32"]
        texts[p["doc_id"], p["doc_tokens"]].append((p["start"], p["ids"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= tokens
    whole = collections.Counter()
    for (key, size), parts in texts.items():
        copies = sum(1 for s, _ in parts if s == 0)
        flat = [x for _, ids in sorted(parts) for x in ids]
        assert len(flat) == size * copies
        if copies == 1:
            whole[key, tuple(flat)] += 1
        else:  # equal rows are cut independently
            whole[key, tuple(wanted[key])] += copies
            assert collections.Counter(flat) == collections.Counter(wanted[key] * copies)
    return whole, {k: sum(n for _, n in v) for k, v in sequences.items()}


def test_packing_round_trip(spark, small, words):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(small, "documents")]
    wanted = {k: words.tokenizer.encode(t, add_special_tokens=False).ids + [2] for k, t in rows}
    pieces = packing.pack_texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), VOCABULARY).collect()
    whole, sizes = check_round_trip(pieces, wanted)
    assert whole == collections.Counter({(k, tuple(v)): 1 for k, v in wanted.items()})
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes.values())  # nothing is padded


def test_packing_odd_rows(odd, nothing, words):
    pieces = packing.pack_texts(odd, VOCABULARY).collect()
    wanted = {r[0]: words.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in ODD if r[0] is not None}
    whole, _ = check_round_trip(pieces, wanted)
    assert sum(whole.values()) == len(ODD)
    assert {p["doc_tokens"] for p in pieces if p["doc_id"] in (1, 2, 3)} == {1}
    assert packing.pack_texts(nothing, VOCABULARY).count() == 0


def test_examples_keep_all_limits_and_are_not_cut(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(100) for _ in range(rng.randrange(1, 60))]) for i in range(300)]
    rows = [(i, ids, [rng.random() < 0.5 for _ in ids]) for i, ids in rows] + [(300, None, None), (301, [], None), (302, [1, 2], [True]), (303, [7] * 130, [None] * 130)]
    limits = packing.Limits(64, 4, 25)
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<int>, loss array<boolean>").repartition(2)
    pieces = packing.pack_examples(df, "doc_id", "ids", "loss", limits).collect()
    marks = {r[0]: [bool(x) for x in (r[2] or [])] for r in rows}
    whole, sizes = check_round_trip(pieces, {r[0]: r[1] or [] for r in rows}, 64)
    assert whole == collections.Counter({(r[0], tuple(r[1])): 1 for r in rows if r[1]})
    weight, count = collections.Counter(), collections.Counter()
    for p in pieces:
        weight[p["sequence_id"]] += sum(marks[p["doc_id"]][p["start"] : p["start"] + p["length"]])
        count[p["sequence_id"]] += 1
        assert p["length"] == p["doc_tokens"] or p["doc_id"] == 303 or sum(marks[p["doc_id"]]) > 25
    assert max(weight.values()) <= 25 and max(count.values()) <= 4
    # Any packing needs as many sequences as the scarcest limit asks for; the heuristic stays near that.
    least = max(sum(sizes.values()) / 64, sum(count.values()) / 4, sum(weight.values()) / 25)
    assert len(sizes) <= 1.25 * least + 2
    with pytest.raises(ValueError):
        packing.Packer(packing.Limits(0), True)


def test_conversations_are_packed_under_three_limits(spark):
    """Every conversation lies whole in one sequence, coded turn by turn; only answers bear loss; each limit binds somewhere."""
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    words = "the cat sat on a mat and then it ran away".split()
    text = lambda k: " ".join(rng.choices(words, k=k))
    shapes = [(30, 2)] * 40 + [(2, 30)] * 40 + [(1, 1)] * 80 + [(150, 3), (3, 150)]
    rows = [(i, [("user", text(q)), ("assistant", text(a))]) for i, (q, a) in enumerate(shapes)]
    rows += [(None, [("user", None), (None, "hi"), None, ("assistant", "")]), (900, []), (901, None), (5, rows[5][1])]
    talks = spark.createDataFrame(rows, "conv_id bigint, turns array<struct<role:string,text:string>>").withColumn("key", F.lit("x"))
    examples = packing.conversation_examples(talks, path)
    coder = Tokenizer.from_file(path)
    expected = collections.Counter()
    for key, turns in rows:
        coded = [([*coder.encode(t[1] or "", add_special_tokens=False).ids, 2], t[0] == "assistant") for t in turns or [] if t]
        expected[key, tuple(x for c, _ in coded for x in c), tuple(a for c, a in coded for _ in c)] += 1
    assert collections.Counter((r["conv_id"], tuple(r["ids"]), tuple(r["loss"])) for r in examples.collect()) == expected

    limits = packing.Limits(105, 6, 64)
    pieces = packing.pack_examples(examples.coalesce(1), "conv_id", "ids", "loss", limits).collect()
    marks = {(k, ids): loss for k, ids, loss in expected}
    totals: dict = {}
    for p in pieces:
        t = totals.setdefault(p["sequence_id"], [0, 0, 0])
        whole = marks.get((p["conv_id"], tuple(p["ids"])))
        assert whole is not None or p["doc_tokens"] > 105  # only what exceeds a sequence is split
        t[0], t[1] = t[0] + p["length"], t[1] + 1
        t[2] += sum(whole) if whole else 0
    assert all(a <= b for t in totals.values() for a, b in zip(t, (105, 6, 64)))
    assert any(t[1] == 6 for t in totals.values()) and any(t[2] > 50 for t in totals.values()) and any(t[0] > 90 for t in totals.values())
    assert sum(p["length"] for p in pieces) == sum(len(ids) * n for (_, ids, _), n in expected.items())


def test_no_conversations_pack_to_nothing(spark):
    talks = spark.createDataFrame([], "conv_id bigint, turns array<struct<role:string,text:string>>")
    examples = packing.conversation_examples(talks, public_tokenizers.path("word_bpe_49k.json"))
    assert packing.pack_examples(examples, "conv_id", "ids", "loss").count() == 0
