"""Language model, language identification and quality model against plain versions."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.llm import gam, hmm, language_id
from tests.llm.conftest import ODD, prose, rows_of

SMALL = hmm.Settings(states=3, own=20, classes=7, hot=40, rounds=2, seeds=10, segment=16)


def words_of(text):
    return (text or "").encode().lower().split()


def held(key, parts):
    return zlib.crc32(("" if key is None else str(key)).encode()) % parts == 0


def brute_scores(rows, v, model, settings, parts):
    """Unigram and forward scores, one text and one step at a time in logarithms."""
    counts = collections.Counter()
    for key, text in rows:
        if not held(key, parts):
            counts.update([*words_of(text), hmm.END])
    total, known = sum(counts.values()), len(counts)
    own = set(v.words[: min(settings.own, len(v.words))])
    of_class = collections.defaultdict(lambda: 0.1)
    for w, c in counts.items():
        if w not in own:
            of_class[hmm.ending_class(w, settings.classes)] += c + 0.1
    out = []
    for key, text in rows:
        tokens = [*words_of(text), hmm.END]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (known + 1))) for w in tokens)
        log, state = 0.0, None
        for w in tokens:
            k = hmm.ending_class(w, settings.classes)
            emit = model.emit[v.words.index(w)] if w in own else model.emit[len(own) + k] * (counts[w] + 0.1) / of_class[k]
            state = (model.start if state is None else state @ model.move) * emit
            log += math.log10(state.sum())
            state = state / state.sum()
        out.append((key, held(key, parts), len(tokens), sum(counts[w] > 0 for w in tokens), total, base, log))
    return sorted(out, key=lambda r: (str(r[0]), r[2]))


def test_scores_equal_a_plain_forward_recursion(spark, monkeypatch):
    rows = [(i, prose(i, 5 + 7 * (i % 9))) for i in range(60)] + [(90, None), (91, ""), (90, None), (None, "unheard words only")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {}
    real = hmm.score
    monkeypatch.setattr(hmm, "score", lambda coded, counts, v, model: kept.update(v=v, model=model) or real(coded, counts, v, model))
    got = sorted((tuple(r) for r in hmm.score_held_out(docs, parts=4, settings=SMALL).collect()), key=lambda r: (str(r[0]), r[2]))
    for a, b in zip(got, brute_scores(rows, kept["v"], kept["model"], SMALL, 4), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    model = kept["model"]
    for p in (model.start, model.move, model.emit.T):
        assert np.allclose(p.sum(axis=-1), 1)


def test_expected_counts_equal_a_sum_over_all_paths():
    """Baum-Welch's forward and backward passes against every path of hidden states of short sequences."""
    import itertools

    rng = np.random.default_rng(2)
    model = hmm.Model(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T)
    sizes = np.array([4, 1, 6, 3])
    flat = rng.integers(0, 5, sizes.sum())
    begins = np.array([True, False, True, False])
    got = hmm.Packed(flat, sizes).expected(model, begins)
    starts, moves, emissions, likelihood = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for seq, first in zip(np.split(flat, np.cumsum(sizes)[:-1]), begins):
        paths = list(itertools.product(range(3), repeat=len(seq)))
        p = []
        for path in paths:
            q = (model.start if first else model.occupied)[path[0]] * model.emit[seq[0], path[0]]
            for t in range(1, len(seq)):
                q *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
            p.append(q)
        for path, q in zip(paths, np.array(p) / sum(p)):
            starts[path[0]] += q * first
            for t, s in enumerate(path):
                emissions[seq[t], s] += q
                if t:
                    moves[path[t - 1], s] += q
        likelihood.append(math.log10(sum(p)))
    assert all(np.allclose(a, b) for a, b in zip(got, (starts, moves, emissions)))
    whole = hmm.Model(model.start, model.start, model.move, model.emit)
    assert np.allclose(hmm.Packed(flat[:4], sizes[:1]).log_likelihoods(whole), likelihood[:1])


def test_rounds_raise_the_likelihood_and_beat_unigrams(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sums = []
    for rounds in (0, 3):
        how = hmm.Settings(own=2000, classes=64, hot=4000, rounds=rounds)
        sums.append(hmm.score_held_out(docs, settings=how).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first())
    assert sums[1][0] > sums[0][0] and sums[1][0] > sums[1][1]


def test_language_model_odd_rows(odd, nothing):
    got = hmm.score_held_out(odd, settings=SMALL).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in ODD)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) and r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert hmm.score_held_out(nothing, settings=SMALL).count() == 0
    only_held = odd.filter(F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    alone = hmm.score_held_out(only_held.withColumn("doc_id", F.lit(29).cast("bigint")), settings=SMALL).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in alone if r["held_out"])


LANGUAGES = ("en", "de", "fr", "es")


def test_language_of_the_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.learn_text(docs.filter("doc_id % 2 = 0"), LANGUAGES)
    got = language_id.identify(docs.filter("doc_id % 2 = 1"), model, ["doc_id", "lang"], declared=None, host=None)
    assert got.filter("language = lang and kept").count() >= 0.97 * got.count()


def test_fusion_equals_a_plain_version(spark):
    """Each piece of evidence by hand: four texts of known likelihood, hosts of two domains, suffixes and declarations."""
    model = language_id.TextModel(("en", "de"), np.log(np.full((language_id.BUCKETS, 3), 1 / language_id.BUCKETS)).astype(np.float32))
    at = language_id.trigrams(b"yes")
    model.logs[at] += np.array([2.0, 1.0, 0.0], np.float32)
    no = language_id.trigrams(b"nein")
    model.logs[no] += np.array([1.0, 2.0, 0.0], np.float32)
    rows = [(1, "yes", "en", "a.x.com", "com"), (2, "yes yes", "de", "a.x.com", "com"), (3, "nein", "de-AT", "b.x.com", "com"), (4, "nein", None, "c.y.de", "de"),
            (5, "", "de", "a.x.com", "de"), (6, None, None, None, None), (7, "12 34", "fr", "b.x.com", ""), (8, "zzzzqqq", "en", "c.y.de", "de"), (1, "yes", "en", "a.x.com", "com")]
    df = spark.createDataFrame(rows, "id bigint, t string, l string, h string, s string").repartition(2)
    got = language_id.identify(df, model, ["id"], "t", "l", "h", "s", strength=2.0).collect()

    size, codes = 2, {"en": "en", "de": "de", "de-AT": "de", "fr": "other", None: None}
    ll = [model.evidence((r[1] or "").encode(), 60) for r in rows]
    best = [int(np.argmax(x[:2])) if len(language_id.trigrams((r[1] or "").encode())) and max(x) > x[2] else None for r, x in zip(rows, ll)]
    count = lambda pick: np.array([sum(b == i and pick(r) for r, b in zip(rows, best)) for i in range(size)], float)
    everything = count(lambda r: True)
    overall = (everything + 1) / (everything.sum() + size)
    domain = lambda h: ".".join(h.split(".")[-2:])
    want = []
    for r, x, b in zip(rows, ll, best):
        share = overall
        if r[3]:
            for name, of in ((domain(r[3]), lambda h: domain(h)), (r[3], lambda h: h)):
                n = count(lambda q: q[3] is not None and of(q[3]) == name)
                share = (n + 2 * share) / (n.sum() + 2)
        logs = np.array(x) + np.log([*(share * 0.99), 0.01])
        if codes[r[2]]:
            n, whole = count(lambda q: codes[q[2]] == codes[r[2]]), count(lambda q: codes[q[2]] is not None)
            logs += np.log([*((n + 0.5) / (whole + 0.5 * 3)), 1 / 3])
        if r[4] and count(lambda q: q[4] == r[4]).sum():
            n = count(lambda q: q[4] == r[4])
            level = n.sum() / (everything.sum() + 2 * size)
            logs += np.array([*np.log((n / (everything + 2) + 0.1 * level) / (1.1 * level)), 0.0])
        p = np.exp(logs - logs.max())
        kept = bool((r[1] or "").strip("0123456789 ")) and logs.argmax() < 2 and 1 / p.sum() >= 0.5
        want.append((r[0], ("en", "de", "und")[int(logs.argmax())], round(1 / p.sum(), 6), "und" if b is None else ("en", "de")[b], kept))
    assert sorted((r["id"], r["language"], round(r["posterior"], 6), r["text_language"], r["kept"]) for r in got) == sorted(want)


def test_language_odd_rows(odd, nothing, spark):
    model = language_id.learn_text(odd, LANGUAGES)
    got = language_id.identify(odd, model, ["doc_id"]).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in ODD)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[i] for i in (1, 2, 3, 12)) and kept[7] and kept[9]
    assert language_id.identify(nothing, language_id.learn_text(nothing, LANGUAGES), ["doc_id"]).count() == 0
    pages = [(1, "https://a.example.de/x", '<HTML  lang="de-DE"><p>Text</p><script>var x</script>'), (2, None, None), (3, "nothing", "plain"), (4, "http://u@h.fr:80", "<html lang=>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    seen = {r["page_id"]: r for r in df.select("page_id", *[c.alias(k) for k, c in language_id.page_evidence().items()]).collect()}
    assert (seen[1]["declared"], seen[1]["suffix"], seen[1]["host"], seen[1]["text"].split()) == ("de", "de", "a.example.de", ["Text"])
    assert seen[4]["host"] == "h.fr" and seen[4]["suffix"] == "fr" and not seen[4]["declared"]
    assert language_id.identify(df, model, ["page_id"], **language_id.page_evidence()).count() == 4


def test_documents_of_languages_without_training_texts_are_kept(spark, small):
    """No row declares a language; then none declares one of the four, whose texts no other language explains."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(-1, "12 34", None, "a"), (-2, None, None, "a")]
    bare = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(spark.createDataFrame(odd, docs.schema))
    got = {r["doc_id"]: r["kept"] for r in language_id.identify(bare, language_id.learn_text(bare, LANGUAGES), ["doc_id"]).collect()}
    assert len(got) == docs.count() + 2 and {k for k, v in got.items() if not v} == {-1, -2}

    strange = "щрж ълю фэц"
    rows = [(-3, strange, None, "a"), (-4, strange, "es", "a"), (-5, strange, "en", "a"), (-6, strange, "xx", "a")]
    known = docs.filter("lang <> 'es'")
    model = language_id.learn_text(known, LANGUAGES)
    assert model.untrained() == ("es",)
    some = known.unionByName(spark.createDataFrame(rows, docs.schema))
    got = {r["doc_id"]: r["kept"] for r in language_id.identify(some, model, ["doc_id"]).filter("doc_id < 0").collect()}
    assert got[-3] and got[-4] and not got[-6]
    assert language_id.learn_text(docs, LANGUAGES).untrained() == ()


def test_tables_learn_a_pairwise_interaction():
    """Neither feature tells anything alone; held-out rows must be told by both."""
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    tables = gam.fit(x[:3000], y[:3000])
    assert (0, 1) in tables.pairs
    logits = tables.logits(x[3000:])
    assert ((logits > 0) == (y[3000:] > 0.5)).mean() > 0.97
    for row, logit in zip(x[3000:3050], logits):  # bin by bin
        one = tables.base + sum(t[sum(row[j] >= e for e in tables.edges[j])] for j, t in enumerate(tables.main))
        one += sum(g[sum(row[i] >= e for e in tables.coarse[i]), sum(row[j] >= e for e in tables.coarse[j])] for (i, j), g in tables.pairs.items())
        assert one == pytest.approx(logit)


def test_shallow_tree_cuts_where_the_slope_changes():
    assert gam.shallow_tree(np.array([5.0, 5.0, -5.0, -5.0]), np.ones(4), 0.0).tolist() == [5.0, 5.0, -5.0, -5.0]
    assert gam.shallow_tree(np.array([3.0]), np.array([1.0]), 1.0).tolist() == [1.5]


def test_quality_on_held_out_documents(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = gam.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    unseen = got[got.held_out]
    assert len(got) and (unseen.predicted == unseen.quality).mean() > 0.95
    assert set(got.doc_id[got.held_out]) == {i for i in got.doc_id if held(i, 5)}


def test_quality_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([(4, 1, "x"), (5, 0, "x"), (5, 1, "x"), (7, 1, "x"), (12, 0, "x"), (8, None, "x"), (None, 0, "x"), (999, 0, "x")], "doc_id bigint, quality int, x string")
    for known in (labels, labels.limit(0)):
        got = gam.quality_scores(odd, known).collect()
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in ODD)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"], 5) for r in got)
    assert all(r["score"] == 0.5 for r in got)
    assert gam.quality_scores(nothing, labels).count() == 0
