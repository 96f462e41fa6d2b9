"""Byte-level BPE against the tiktoken library, against contraction by the definition, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tableprep.llm import byte_bpe
from tableprep.llm.queries import QUERIES
from tests.llm.conftest import rows_of

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def merger():
    return byte_bpe.Merger(RANKS, PATTERN, True)


def test_query_equals_the_library(spark, small, library):
    got = {r["doc_id"]: r for r in QUERIES["op13_byte_bpe"](spark, small).collect()}
    docs = rows_of(small, "documents")
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode_ordinary(d["text"]), got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


def test_odd_rows_and_nothing(spark, odd, nothing, library):
    coded = byte_bpe.encode(odd, RANKS, PATTERN)
    got = sorted((str(r["doc_id"]), r["ids"]) for r in coded.collect())
    assert got == sorted((str(r["doc_id"]), library.encode_ordinary(r["text"] or "")) for r in odd.select("doc_id", "text").collect())
    back = byte_bpe.decode(coded, RANKS, PATTERN, ["doc_id"]).collect()
    texts = sorted((str(r["doc_id"]), (r["text"] or "").encode()) for r in odd.select("doc_id", "text").collect())
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in back) == texts
    assert byte_bpe.encode(nothing, RANKS, PATTERN).collect() == []
    assert byte_bpe.decode(byte_bpe.encode(nothing, RANKS, PATTERN), RANKS, PATTERN, ["doc_id"]).collect() == []


def test_lists_that_are_no_ids(spark):
    df = spark.createDataFrame([(1, [64, 65]), (2, []), (3, None), (4, [64, None]), (5, [99_999_999])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in byte_bpe.decode(df, RANKS, PATTERN, ["k"]).collect()}
    assert {k: v if v is None else bytes(v) for k, v in got.items()} == {1: b"ab", 2: b"", 3: b"", 4: None, 5: None}


def test_code_points_white_space_and_long_words(merger, library):
    rng = random.Random(5)
    marks = [chr(c) for c in range(0x3100)] + [chr(rng.randrange(0xE000, 0x110000)) for _ in range(500)]
    texts = [form.format(c) for c in marks for form in ("{0}", "a{0}a", " {0} {0}", "1{0}.")]
    texts += ["".join(rng.choice(" \n\t\x0b\x0c\r\x1c\x85\xa0 ab1'") for _ in range(rng.randrange(40))) for _ in range(500)]
    texts += ["x" * 20_001, "ab" * 5_000 + "a", "".join(rng.choice("abcdefg") for _ in range(3_000)), " " * 70_000 + "a", "it's we'LL <|endoftext|>"]
    assert [i.tolist() for i in merger.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_texts_cut_at_every_place(merger, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 7)
    monkeypatch.setattr(byte_bpe, "SLICE", 50)
    monkeypatch.setattr(byte_bpe, "LONG", 9)
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "be", " ", "  ", "\n", "é", "9", "'s", "…", " "]) for _ in range(300)) for _ in range(60)]
    assert [i.tolist() for i in merger.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    import pyarrow as pa

    lists = pa.array([library.encode_ordinary(t) for t in texts], pa.list_(pa.int32()))
    assert merger.decode(lists) == [t.encode() for t in texts]
    assert merger.decode(lists.slice(7, 9)) == [t.encode() for t in texts[7:16]]


def test_memory_of_words_is_bounded(library):
    few = byte_bpe.Merger(RANKS, PATTERN, True, most=50)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("qzxv") for _ in range(6)) for _ in range(n)) for n in (10, 45, 30, 200, 20)]
    for t in texts:
        assert few.encode([t])[0].tolist() == library.encode_ordinary(t)
    assert len(few.words) <= 50


def by_definition(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, at = min(found)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_ranks_that_are_out_of_order_contract_one_place_a_round(tmp_path, monkeypatch):
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"cab", b"aa", b"aaa", b"abab"]
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    assert not byte_bpe.merges_in_order(str(path)) and byte_bpe.merges_in_order(RANKS)
    odd, ranks = byte_bpe.Merger(str(path), PATTERN, False), byte_bpe.read_ranks(str(path))
    rng = random.Random(8)
    monkeypatch.setattr(byte_bpe, "LONG", 12)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    for word, ids in zip(words, odd.encode(words)):
        assert ids.tolist() == ([ranks[word.encode()]] if word.encode() in ranks else by_definition(word.encode(), ranks))
