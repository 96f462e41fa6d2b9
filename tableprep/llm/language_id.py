"""Language ID by Bayesian fusion: text likelihoods, declared language, address suffix and smoothed host priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableprep.llm.text import arrow_map, utf8
from tableprep.llm.url_filter import host_of
from tableprep.plans.scratch import materialize

UNKNOWN = "und"
BUCKETS = 1 << 15
# ASCII other than letters becomes a space, A-Z lower case; bytes of other characters stay.
LETTERS = bytes(ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(128)) + bytes(range(128, 256))
DECLARED = r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})\b"""
STRIPPED = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the three-byte windows of the letters of a text, single spaces between words."""
    words = text.translate(LETTERS).split()
    if not words:
        return np.zeros(0, np.int64)
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    h = (a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA6B)) + a[2:] * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64)


@dataclass
class TextModel:
    """``logs``: log probability of a bucket in each language, and in none (all buckets alike), as the last column."""

    languages: tuple[str, ...]
    logs: np.ndarray

    def evidence(self, text: bytes, effective: int) -> list[float]:
        """Log likelihoods. Neighbouring windows repeat each other, so at most ``effective`` of them count in full."""
        at = trigrams(text)
        if not len(at):
            return [0.0] * self.logs.shape[1]
        return (self.logs[at].sum(axis=0, dtype=float) * (min(len(at), effective) / len(at))).tolist()

    def untrained(self) -> tuple[str, ...]:
        """Languages without training texts: their windows are as even as those of none, so texts say nothing of them."""
        even = np.abs(self.logs[:, :-1] - self.logs[:, -1:]).max(axis=0) < 1e-4
        return tuple(x for x, e in zip(self.languages, even) if e)


def declared_code(column: Column) -> Column:
    """Primary part of a language tag in lower case; null if there is none."""
    code = F.lower(F.regexp_extract(column, r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))
    return F.when(code != "", code)


def learn_text(docs: DataFrame, languages: tuple[str, ...], text: str = "text", declared: str = "lang") -> TextModel:
    """Window counts of each language over all texts that declare it, summed in each task and then over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BUCKETS))
        for b in batches:
            for language, raw in zip(b["language"].to_pylist(), utf8(b["text"])):
                sums[languages.index(language)] += np.bincount(trigrams(raw), minlength=BUCKETS)
        who, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(at), pa.array(sums[who, at])], ["who", "bucket", "n"])

    labelled = docs.select(declared_code(F.col(f"`{declared}`")).alias("language"), F.col(f"`{text}`").alias("text"))
    labelled = labelled.filter(F.col("language").isin(*languages) & F.col("text").isNotNull())
    rows = arrow_map(labelled, {"language": "language", "text": "text"}, count, "who bigint, bucket bigint, n double")
    rows = rows.groupBy("who", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.full((BUCKETS, len(languages)), 0.5)
    sums[rows["bucket"].to_numpy(), rows["who"].to_numpy()] += rows["n"].to_numpy()
    # A fifth of the mass is even over all buckets: words that the training texts lack count little against a language.
    logs = np.log(0.8 * sums / sums.sum(axis=0) + 0.2 / BUCKETS)
    return TextModel(languages, np.concatenate([logs, np.full((BUCKETS, 1), -np.log(BUCKETS))], axis=1).astype(np.float32))


def _read(df: DataFrame, model: TextModel, effective: int, carry: list[str]) -> DataFrame:
    """``carry`` columns and the text's log likelihoods ``ll``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = pa.array([sent.value.evidence(t, effective) for t in utf8(b["text"])], pa.list_(pa.float64()))
            letters = pa.array([len(t.translate(LETTERS, b" ").strip()) > 0 for t in utf8(b["text"])], pa.bool_())
            yield pa.RecordBatch.from_arrays([*[b[c] for c in carry], values, letters], [*carry, "ll", "letters"])

    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return arrow_map(df, {c: c for c in [*carry, *["text"] * ("text" not in carry)]}, work, f"{types}, ll array<double>, letters boolean")


def _shares(df: DataFrame, by: list[str], languages: tuple[str, ...]) -> DataFrame:
    """Texts of each language by their likelihoods alone, for each value of ``by``, as an array."""
    return df.groupBy(*by).agg(F.array(*[F.sum(F.when(F.col("best") == i, F.col("texts")).otherwise(0.0)) for i in range(len(languages))]).alias("n"))


def _smoothed(counts: Column, prior: Column, strength: float) -> Column:
    """Shares drawn towards ``prior`` as by ``strength`` further texts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda n, p: (n + strength * p) / (total + strength))


def identify(
    docs: DataFrame, model: TextModel, keep: list[str], text: str | Column = "text", declared: str | Column | None = "lang",
    host: str | Column | None = "source", suffix: str | Column | None = None, wanted: tuple[str, ...] | None = None, least: float = 0.5,
    effective: int = 60, strength: float = 20.0, unknown: float = 0.01,
) -> DataFrame:
    """Columns ``keep`` with ``language``, ``posterior``, ``text_language`` and ``kept``.

    Evidence, each as log probabilities of the languages and of none ("und"): the text's windows; the declared language
    by how often texts of a language declare it; the address suffix likewise; and a prior of the host: the languages of
    its texts, smoothed towards those of its domain (the last two parts of its name), those towards all texts. All
    are grouped counts over the whole table, by the language that a text shows by itself. A document is kept if the
    most probable language is one of ``wanted`` (all languages of the model) with ``least`` probability, and if the
    text has letters. Where a wanted language has no training texts, nothing speaks against a document that no
    language's windows explain and that declares such a language or none: it is kept too, whatever its probability.

    A null or missing piece of evidence says nothing; a null or empty text has no letters and is rejected, its language
    comes from the rest; repeated rows count and return each; no documents give no rows; ties go to the language named
    first; other columns than ``keep`` are not read.
    """
    size, languages = len(model.languages), model.languages
    names = {f"keep_{i}": c for i, c in enumerate(keep)}
    column = lambda c: F.lit(None).cast("string") if c is None else F.col(f"`{c}`").cast("string") if isinstance(c, str) else c
    code = declared_code(column(declared))
    source = docs.select(
        *[F.col(f"`{c}`").alias(k) for k, c in names.items()], column(text).alias("text"),
        F.when(code.isin(*languages), code).when(code.isNotNull(), "other").alias("declared"),
        F.nullif(column(suffix), F.lit("")).alias("suffix"), F.nullif(column(host), F.lit("")).alias("host"),
    ).withColumn("domain", F.regexp_extract("host", r"([^.]+\.)?[^.]+$", 0))
    evidence = ["declared", "suffix", "host", "domain"]
    real = F.slice("ll", 1, size)
    best = F.when(F.col("letters") & (F.array_max("ll") > F.col("ll")[size]), F.array_position(real, F.array_max(real)).cast("int") - 1)
    # The counts need no texts; these are read again at the end rather than stored beside their likelihoods.
    seen = _read(source, model, effective, evidence).withColumn("best", best).filter("best is not null")
    seen = materialize(seen.select(*evidence, "best").groupBy(*evidence, "best").agg(F.count("*").cast("double").alias("texts")), "evidence")
    found = _read(source, model, effective, [*names, *evidence]).withColumn("best", best)

    all_counts = _shares(seen, [], languages).first()["n"]
    if all_counts is None or all_counts[0] is None:
        all_counts = [0.0] * size
    total = sum(all_counts)
    overall = [(n + 1) / (total + size) for n in all_counts]
    flat = lambda values: F.array(*[F.lit(float(v)) for v in values])

    declares = {r["declared"]: r["n"] for r in _shares(seen.filter("declared is not null"), ["declared"], languages).collect()}  # a row for each language
    declared_of = {}
    for d in (*languages, "other"):
        n = declares.get(d, [0.0] * size)
        whole = [sum(declares.get(e, [0.0] * size)[i] for e in (*languages, "other")) for i in range(size)]
        declared_of[d] = np.log([(n[i] + 0.5) / (whole[i] + 0.5 * (size + 1)) for i in range(size)] + [1 / (size + 1)])
    by_declared = F.lit(None).cast("array<double>")
    for d, logs in declared_of.items():
        by_declared = F.when(F.col("declared") == d, flat(logs)).otherwise(by_declared)

    domains = _shares(seen.filter("host is not null"), ["domain"], languages)
    domains = domains.select("domain", _smoothed(F.col("n"), flat(overall), strength).alias("domain_share"))
    hosts = _shares(seen.filter("host is not null"), ["host", "domain"], languages).join(domains, "domain")
    # Stored, so that their true size decides how they are joined to the texts.
    hosts = materialize(hosts.select("host", _smoothed(F.col("n"), F.col("domain_share"), strength).alias("host_share")), "hosts")
    suffixes = _shares(seen.filter("suffix is not null"), ["suffix"], languages)
    # P(suffix | language) up to a factor that all languages share: the suffix's share of the language's texts.
    rates = F.zip_with("n", flat([n + strength for n in all_counts]), lambda n, t: n / t)
    level = F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / F.lit(total + strength * size)
    suffixes = suffixes.select("suffix", F.transform(rates, lambda r: F.log((r + 0.1 * level) / (1.1 * level))).alias("suffix_logs"))
    suffixes = materialize(suffixes, "suffixes")

    prior = F.concat(
        F.transform(F.coalesce("host_share", flat(overall)), lambda p: F.log(p * (1 - unknown))), F.array(F.lit(float(np.log(unknown))))
    )
    zero = flat([0.0] * (size + 1))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = plus(plus(F.col("ll"), prior), plus(F.coalesce(by_declared, zero), F.coalesce(F.concat("suffix_logs", F.array(F.lit(0.0))), zero)))
    joined = found.join(hosts, "host", "left").join(suffixes, "suffix", "left").withColumn("logs", logs)
    top = F.array_max("logs")
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    label = F.array(*[F.lit(x) for x in (*languages, UNKNOWN)])
    language = F.element_at(label, F.array_position("logs", top).cast("int"))
    unseen = [x for x in model.untrained() if x in (wanted or languages)]
    unjudged = F.col("best").isNull() & (F.col("declared").isNull() | F.col("declared").isin(*unseen)) if unseen else F.lit(False)
    out = joined.select(
        *names, language.alias("language"), posterior.alias("posterior"), F.get(label, F.coalesce("best", F.lit(size))).alias("text_language"), "letters",
        unjudged.alias("unjudged"),
    )
    kept = F.col("language").isin(*(wanted or languages)) & (F.col("posterior") >= least)
    return out.withColumn("kept", F.col("letters") & (kept | F.col("unjudged"))).drop("letters", "unjudged").withColumnsRenamed(names)


def page_evidence(url: str = "url", html: str = "html") -> dict[str, Column]:
    """Text, declared language, host and suffix of web pages, as arguments of :func:`identify`."""
    host = F.regexp_replace(host_of(F.col(url)), r"^[^@]*@|:[0-9]*$", "")
    return {
        "text": F.regexp_replace(F.col(html), STRIPPED, " "),
        "declared": F.regexp_extract(F.col(html), DECLARED, 1),
        "host": host,
        "suffix": F.regexp_extract(host, r"\.([a-z]{2,})$", 1),
    }
