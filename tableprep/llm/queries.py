"""Registered queries of the text operators, with production settings, and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tableprep.llm import byte_bpe, decontamination, fill_middle, gam, hmm, language_id, line_frequency, ngram_join, oracles, packing, preferences, secrets, url_filter, whitening

QUERIES, ORACLES = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def contaminated_spans(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each passage of a document that windows of benchmark items cover, with its offsets in the text."""
    found = decontamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id", "text"])
    spans = found.select("doc_id", "text", F.inline("spans"))
    passage = F.substring("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return spans.select(
        "doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"),
        F.size(F.split(passage, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint").alias("n_words"),
    )


@query
def op4_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return line_frequency.line_frequency_filter(table(spark, folder, "documents"))[0]


@query
def op6_linked_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.linked_spans(table(spark, folder, "documents"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.as_text("base").cast("binary"), 256).alias("base_sha256"), secrets.as_text("spans").alias("spans"),
    )


@query
def op10_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_texts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query
def packed_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Whole conversations under three limits: tokens, segments, and tokens of answers, which alone bear loss."""
    talks = preferences.conversations(table(spark, folder, "conversations"))
    examples = packing.conversation_examples(talks, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_examples(examples, "conv_id", "ids", "loss", packing.Limits(4096, 8, 3072), with_ids=False)


@query
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


# The rules of the query, (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op2_link_graph(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES)


@query
def op8_preferences(spark: SparkSession, folder: str) -> DataFrame:
    talks = preferences.conversations(table(spark, folder, "conversations"))
    return preferences.format_preferences(preferences.stale_reply_pairs(talks))


@query
def op1_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score_held_out(table(spark, folder, "documents"))


@query
def op9_additive_model(spark: SparkSession, folder: str) -> DataFrame:
    return gam.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


LANGUAGES = ("en", "de", "fr", "es")


@query
def op5_language_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Documents declare their language in ``lang``; their host is ``source``."""
    docs = table(spark, folder, "documents")
    return language_id.identify(docs, language_id.learn_text(docs, LANGUAGES), ["doc_id"])


@query
def pages_language(spark: SparkSession, folder: str) -> DataFrame:
    """The same over web pages: markup language, host and address suffix; the text model is learnt from the documents."""
    model = language_id.learn_text(table(spark, folder, "documents"), LANGUAGES)
    return language_id.identify(table(spark, folder, "pages"), model, ["page_id"], **language_id.page_evidence())


@query
def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(table(spark, folder, "documents"), ranks, pattern).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), "ids",
    )
    found = byte_bpe.decode(coded, ranks, pattern, ["doc_id", "n_tokens", "ids_sha256"])
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_polarisation(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    model = whitening.fit_whitening(vectors)
    found = whitening.whiten(vectors, model).select(
        "vec_id", F.posexplode("whitened").alias("place", "whitened"), F.expr("try_cast(deviation AS bigint)").alias("deviation")
    )
    shares = [float(e) for e in model.explained] if model else []
    return found.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(F.lit(shares).cast("array<double>"), F.col("place") + 1).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


@query
def op12_displacement(spark: SparkSession, folder: str) -> DataFrame:
    shown = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    made = made.select(*shown, "output", F.sha2("output", 256).alias("output_sha256"))
    found = fill_middle.restore(made, [*shown, "output_sha256"])
    return found.select(*shown, "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


ORACLES["op3_decontamination"] = oracles.DECONTAMINATION
ORACLES["contaminated_spans"] = oracles.CONTAMINATED_SPANS
ORACLES["op4_line_frequency"] = oracles.LINE_FREQUENCY
ORACLES["op12_displacement"] = oracles.DISPLACEMENT
ORACLES["op7_ngram_join"] = oracles.NGRAM_JOIN
ORACLES["op8_preferences"] = oracles.PREFERENCES
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
