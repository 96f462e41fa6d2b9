"""The pipeline stage by stage against plain versions, and with odd rows."""

import collections

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tableprep.llm.tokens import WordIds
from tests.llm.conftest import ODD, prose, rows_of
from tests.llm.test_join_and_packing import brute_components
from tests.llm.test_text_rules import brute_contamination, brute_spans


def test_stages_equal_plain_versions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = rows_of(small, "documents")
    planted = [
        {**r, "doc_id": 10**6 + i, "text": " ".join(reversed(r["text"].split())) + x} for i, (r, x) in enumerate(zip(kept[1:3], (
            ' token = "0123456789abcdef0123456789"\nend', " user: someone aB3dE5gH7jK9mN1pQ3sT5 password=hunter2hunter2password=hunter2hunter2")))
    ]
    kept = kept + planted
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "packing"]

    got = stages["language_id"](spark, docs, small)
    assert got.columns == docs.columns
    # Every document of the table is prose of one of the languages.
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))

    got = stages["ngram_jaccard_join"](spark, docs, small)
    group = {k: c for k, _, c in brute_components([(r["doc_id"], r["text"]) for r in kept])}
    kept = [r for r in kept if group[r["doc_id"]] == r["doc_id"]]
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in kept)

    got = stages["benchmark_decontamination"](spark, got, small)
    items = [(r["item_id"], r["text"]) for r in rows_of(small, "benchmark")]
    bad = {r[0] for r in brute_contamination([(r["doc_id"], r["text"]) for r in kept], items, 10) if r[2]}
    kept = [r for r in kept if r["doc_id"] not in bad]
    assert bad and got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in kept)

    got = {r["doc_id"]: r for r in stages["secret_scans"](spark, got, small).collect()}
    assert len(got) == len(kept)
    for r in kept:
        text, at, out = r["text"], 0, ""
        for _, a, b in (s.split(":") for s in brute_spans(text, 300)[1].split(",") if s):
            if int(a) >= at:
                out += text[at : int(a)] + "[SECRET]"
            at = max(at, int(b))
        assert got[r["doc_id"]]["text"] == out + text[at:] and got[r["doc_id"]]["n_chars"] == len(out + text[at:])
    assert any("[SECRET]" in r["text"] for r in got.values())

    pieces = corpus_pipeline.run(spark, small).collect()
    tokenizer = WordIds(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = {k: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for k, r in got.items() if k < 10**6}
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == want
    total = collections.Counter()
    for p in pieces:
        total[p["doc_id"]] += p["length"]
    assert total == want


def test_stages_with_odd_rows(spark, odd, nothing, small):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == odd.columns and out.schema["text"].dataType == odd.schema["text"].dataType
        assert stage(spark, nothing, small).count() == 0
        rows = out.collect()
        assert all(r["spans"] == r["language" if "language" in odd.columns else "row"] == "clash" for r in rows)
        docs = spark.createDataFrame(rows, odd.schema)
    ids = collections.Counter(r["doc_id"] for r in rows)
    # Texts without letters or in no known language are gone, of equal and near texts one is left, a row without an id stays.
    assert ids == collections.Counter([4, 6, 7, 9, 11, None])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).select("doc_id").distinct().count() == 6


def test_join_stage_tells_rows_of_one_id_apart(spark, small):
    """Rows of one id with different texts, and copies without an id."""
    a, b, c, d = (prose(i, 120) for i in range(10, 14))
    near = b.replace("river", "rivers", 1) + " end"
    rows = [(5, a), (5, near), (-3, b), (7, c), (7, d), (7, d), (None, near), (None, a), *[(None, prose(14, 120))] * 3, (None, prose(14, 120) + " end"), (20, prose(15, 120)), (100, prose(15, 120))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, small)
    assert got.columns == docs.columns
    found = collections.Counter(map(tuple, got.collect()))
    of_none = [k for k in found if k[0] is None]
    assert len(of_none) == 1 and of_none[0][1].startswith(prose(14, 120)) and found.pop(of_none[0]) == 1
    assert found == collections.Counter([(5, a), (-3, b), (7, c), (7, d), (20, prose(15, 120))])
    names = docs.withColumn("doc_id", F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    assert dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, names, small).count() == 6


def test_join_stage_takes_files_in_slices(spark, small, tmp_path, monkeypatch):
    """Several files and bitmaps, slices of few bitmaps, and no text in a shuffle."""
    rows = [(i, prose(50 + i % 60, 40), "c") for i in range(200)] + [(None, prose(50, 40), "c"), (3, "", "c"), (3, "", "c")]
    spark.createDataFrame(rows, "doc_id bigint, text string, _metadata string").repartition(7).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    for covered, bitmaps in ((8, 2),):
        monkeypatch.setattr(corpus_pipeline, "COVERED", covered)
        monkeypatch.setattr(corpus_pipeline, "BITMAPS", bitmaps)
        got = stage(spark, docs, small)
        assert got.columns == docs.columns
        assert collections.Counter(r["doc_id"] for r in got.collect()) == collections.Counter([*range(60), 3, 3])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
