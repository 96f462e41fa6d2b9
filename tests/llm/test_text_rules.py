"""Decontamination, line frequency and secret scans against plain versions of their rules."""

import collections
import hashlib
import inspect
import random
import re

import duckdb
import pytest

import __spark_entry__ as contract
import check
from tableprep.llm import decontamination, line_frequency, secrets
from tests.llm.conftest import ODD, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_decontamination", "contaminated_spans", "op4_line_frequency", "op7_ngram_join", "op8_preferences"])
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for t in check.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = contract.queries()[name](spark, FOLDER)
    result = db.execute(contract.oracle_sql()[name])
    assert check.rows_of(df.columns, df.collect()) == check.rows_of([c[0] for c in result.description], result.fetchall())


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items, window):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(item)
    out = []
    for key, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for g, ids in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= {str(x) for x in ids if x is not None}
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


ITEMS = [
    (1, "One, TWO three"), (10, "three four five six"), (2, "three four five six"), (3, None), (4, ""), (None, "seven eight"), (5, "...!"),
    (6, "ß 日本語"), (7, "a a a a a a"), (8, " ".join(f"w{i}" for i in range(25))), (1, "One, TWO three"),
]
DOCS = [
    (1, "zero one two three four five six seven eight nine"), (2, "one-two-three"), (3, "four three four five sixes"), (4, "a a a a a a a b a a a"),
    (5, " ".join(f"W{i}" for i in range(3, 22))), (6, "ẞ ß\n日本語!"), (7, None), (8, ""), (9, "seven. Eight, seven eight"), (None, "one two three"),
]


@pytest.mark.parametrize("size", [1, 64 << 20])
@pytest.mark.parametrize("window", [3, 4, 10])
def test_contamination_equals_brute_force(spark, window, size):
    """Also with one automaton for each few bytes of items: parts must add up to the whole."""
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").repartition(2)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontamination.find_contamination(docs, items, ["doc_id"], window=window, automaton_bytes=max(size, 40)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == brute_contamination(DOCS, ITEMS, window)
    texts = dict(DOCS)
    for r in got:
        assert r["n_items"] == len(r["items"]) and r["contaminated"] == (r["n_hit"] > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        # Spans map to the text as it was: their words are the words that were hit.
        assert sum(len(plain_words(texts[r["doc_id"]][s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"]


def test_parts_of_items_bound_a_workers_memory(spark):
    """By the default an automaton stays below 600 MB, and a worker has that of one part only."""
    rng = random.Random(0)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(5000))
    size = decontamination.build([("1", text.encode())], 10).get_stats()["total_size"]
    assert size / len(text) * inspect.signature(decontamination.find_contamination).parameters["automaton_bytes"].default < 600e6
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontamination.find_contamination(docs, items, ["doc_id"], window=3, automaton_bytes=100)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_items_are_sent_once_in_pieces_that_keep_every_window(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 7)
    long = " ".join(f"w{i}" for i in range(50))
    items = spark.createDataFrame([(1, long), (2, long.upper()), (3, "a b"), (None, "a  b!"), (4, None), (5, "?")], "item_id bigint, text string")
    rows = decontamination.item_pieces(items, "item_id", "text", 4).collect()
    pieces = {r["words"]: sorted(r["ids"]) for r in rows}
    assert len(pieces) == len(rows) and pieces.pop("a b") == ["3"] and set(map(tuple, pieces.values())) == {("1", "2")}
    words = long.split()
    windows = [" ".join(p.split()[i : i + 4]) for p in pieces for i in range(len(p.split()) - 3)]
    assert sorted(windows) == sorted(" ".join(words[i : i + 4]) for i in range(47))
    docs = spark.createDataFrame([(1, "x " + long + " y"), (2, " ".join(words[5:9]))], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontamination.find_contamination(docs, items, ["doc_id"], window=4).collect()}
    assert got == {1: (50, ["1", "2"]), 2: (4, ["1", "2"])}


def test_a_window_of_many_items_is_one_pattern():
    shared = "a b c d e f g h i j"
    automaton = decontamination.build([([str(n)], f"{shared} {n} {shared}".encode()) for n in range(200)], 10)
    ranges, items = decontamination.occurrences(automaton, f"z {shared} y {shared} z".encode().split())
    assert ranges == [[1, 11], [12, 22]] and items == {str(n) for n in range(200)}
    assert len(automaton.trie) == 1 + 200 * 10 and automaton.more[0] == list(range(200))


def test_contamination_odd_rows(odd, nothing, spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "x" * 100_000)], "item_id bigint, text string")
    got = {(r["doc_id"], r["n_hit"]) for r in decontamination.find_contamination(odd, items, ["doc_id", "keep_0", "items"]).select("doc_id", "n_hit").collect()}
    assert {(4, 3), (5, 3), (10, 1), (1, 0), (2, 0), (None, 0)} <= got
    assert decontamination.find_contamination(odd, items.limit(0), ["doc_id"]).filter("contaminated").count() == 0
    assert decontamination.find_contamination(nothing, items, ["doc_id"]).count() == 0


def test_repeated_words_of_windows():
    for text in ("a b c a b c", "a a a a", "a b", "", "a b c", "x a b c y a b c z", "a b c d e f a b d"):
        w = text.split()
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        marked = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert line_frequency.repeated_words([x.encode() for x in w]) == len(marked)


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    letters = lambda n: chr(97 + n // 26) + chr(97 + n % 26)
    own = lambda i: " ".join(letters(i) + letters(j) for j in range(60))
    rows = [(i, f"{own(i)}\nAll rights  reserved {10 + i}", "a") for i in range(30)]
    rows += [(100 + i, "All RIGHTS reserved 99\n" * 30 + f"short {letters(i)}", "a") for i in range(3)]
    rows += [(200 + i, own(0) + "\nonly here", "b") for i in range(9)]
    rows += [(300 + i, own(1), "c") for i in range(10)]  # documents are counted, copies too
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    verdicts, frequent = line_frequency.line_frequency_filter(docs, least_docs=10)
    got = {r["doc_id"]: r for r in verdicts.collect()}
    assert sorted(r["host"] for r in frequent.collect()) == ["a", "c"]  # numbers are alike, and so are spaces
    assert all(got[i]["kept"] and got[i]["removed_words"] == 4 for i in range(30))
    assert all(not got[100 + i]["kept"] and got[100 + i]["removed_words"] == 120 for i in range(3))
    assert all(got[200 + i]["kept"] for i in range(9)) and not any(got[300 + i]["kept"] for i in range(10))
    texts = {r["doc_id"]: r["text"] for r in line_frequency.strip_lines(docs, frequent).collect()}
    assert texts[3] == own(3) and texts[101] == "short ab" and texts[200] == rows[33][1]


def test_a_lines_verdict_does_not_weaken_as_its_host_grows(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    for others in (0, 20_000):
        rows = [(i, f"shared line of words\nown {letters(i)}", "a") for i in range(12)]
        rows += [(100 + i, f"other {letters(i)}", "a") for i in range(others)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        assert [r["docs"] for r in line_frequency.line_frequency_filter(docs)[1].collect()] == [12]


def test_line_frequency_odd_rows(odd, nothing):
    verdicts, frequent = line_frequency.line_frequency_filter(odd)
    got = collections.Counter((r["doc_id"], r["n_words"], r["kept"]) for r in verdicts.collect())
    assert sum(got.values()) == len(ODD) and got[7, 300, True] == 2 and got[1, 0, False] == got[2, 0, False] == 1 and got[None, 0, False] == 1
    assert frequent.count() == 0
    stripped = {r["doc_id"]: r["text"] for r in line_frequency.strip_lines(odd, frequent).collect()}
    assert all(stripped[r[0]] == r[1] for r in ODD if r[0] is not None)
    assert line_frequency.line_frequency_filter(nothing)[0].count() == 0


BASE = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
]
WEAK = [("account", secrets.ACCOUNT, "id"), ("opaque", secrets.OPAQUE, "secret"), ("endpoint", secrets.ENDPOINT, "endpoint")]
ROLE = {"assign": "secret", "access": "id", "hex": "secret"}
ORDER = ["assign", "access", "hex", "account", "opaque", "endpoint"]


def brute_spans(text, scope):
    """Strong spans by the rules; weak ones by comparing all parts with each other."""
    text = text or ""
    base = [(m.start(), k, m.end()) for k, p, f, ok in BASE for m in re.finditer(p, text, f) if ok(m)]
    weak = [(m.start(), k, m.end(), role) for k, p, role in WEAK for m in p.finditer(text)]
    weak = [w for w in weak if not any(s < w[2] and e > w[0] for s, _, e in base)]
    parts = [(s, k, e, ROLE[k]) for s, k, e in base] + weak
    linked = [
        w[:3] for w in weak
        if any(o[3] != w[3] and "secret" in (o[3], w[3]) and o[0] <= w[2] + scope and o[2] >= w[0] - scope for o in parts)
    ]
    order = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], ORDER.index(x[1]), x[2])))
    return order(base), order(base + linked)


FAR = " lorem" * 20
SECRETS = [
    "password = 'hunter2hunter2' token:abc api-key=1234567 API_KEY: zzzzzz", "AKIA" + "Z9" * 8, "AKIA" + "Z9" * 7, "deadbeef" * 3 + "g" + "abc123" * 5,
    "user: alice aB3dE5gH7jK9mN1pQ3sT5", "user: alice" + FAR + "aB3dE5gH7jK9mN1pQ3sT5", "see https://host.example.org:8080/x?token=abcdefgh",
    "https://host.example.org alone", "login=bob https://h.example.com", "aB3dE5gH7jK9mN1pQ3sT5 alone", "é日😀 client_id=abc123 " + "0123456789abcdef" * 2,
    "user: a1" + FAR + "aB3dE5gH7jK9mN1pQ3sT5" + FAR + "ftp://x.example.com", "ſecret=abcdefg toKen=abcdefg", "secret=secret=abcdefgh", "token\n=abcdefgh", None, "",
]


@pytest.mark.parametrize("scope", [10, 50, 300])
def test_secrets_equal_brute_force(spark, small, scope):
    rows = list(enumerate(SECRETS + [r["text"] for r in rows_of(small, "documents")]))
    rows += [(1000, " ".join(SECRETS[i % 12] + FAR * (i % 3) for i in range(400)))]
    found = secrets.linked_spans(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), ["doc_id"], scope=scope)
    got = {r[0]: (r[1], r[2]) for r in found.select("doc_id", secrets.as_text("base"), secrets.as_text("spans")).collect()}
    assert got == {k: brute_spans(t, scope) for k, t in rows}
    assert any(a != b for a, b in got.values())


def test_secrets_odd_rows(odd, nothing):
    got = collections.Counter(r[0] for r in secrets.linked_spans(odd, ["doc_id", "spans", "row"]).select("doc_id").collect())
    assert got == collections.Counter(r[0] for r in ODD)
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"], r["spans"]) for r in clean.collect()}
    before = {r[0]: r[1] for r in ODD}
    assert "[SECRET]" in texts[6][0] and "abcdef" not in texts[6][0] and texts[6][1] == len(texts[6][0]) and texts[6][2] == "clash"
    assert "hunter2" not in texts[11][0] and "AKIA" not in texts[11][0] and "someone" not in texts[11][0]
    assert all(texts[k][0] == before[k] for k in (1, 2, 3, 4, 7, 9, 10, 12))
    assert secrets.redact(nothing).count() == 0
