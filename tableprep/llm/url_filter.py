"""URL filters: rules, and link-graph propagation of trust and distrust between hosts for what no rule decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tableprep.plans.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column | str) -> Column:
    """From after the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the (verdict, host, path) rules that fits, as struct<length, rule, verdict>; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's; of two as long the greater text wins.
    """
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in rules
    ]
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array(none, *fits))


def host_links(pages: DataFrame, host: Column, html: str) -> DataFrame:
    """(source, target, weight): on how many pages of a host another host is linked."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.col(f"`{html}`"), F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))
    return (
        pages.select(host.alias("source"), F.explode(targets).alias("target")).filter("source <> target and source <> ''")
        .groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))
    )


def rounds_for(least: float, damping: float) -> int:
    """Rounds after which no more than a thousandth of ``least`` of any score is still open."""
    return max(1, math.ceil(math.log(least / 1000) / math.log(damping)))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(kind, host, score, part): ``trust`` flows along the links, ``distrust`` against them, both in the same jobs.

    ``seeds``: (kind, host). ``score`` is personalised PageRank: restarts go to the seeds evenly; so does the rank of
    hosts without links onward. Scores are shares of one seed's restart, so they do not depend on the number of seeds,
    but a seed's score is divided among its neighbours. ``part`` is the same rank normalised by the degree of the host
    that receives it: a seed has 1, another host ``damping`` times the mean over its own links, by weight, of what they
    lead to (distrust) or come from (trust), so in-degree does not dilute it. Stops when no rank moves, else after
    ``rounds`` rounds, when at most ``damping ** rounds`` of either is still open.
    """
    onward = links.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "weight").unionAll(
        links.select(F.lit("distrust"), F.col("target"), F.col("source"), "weight")
    )
    given = onward.groupBy("kind", "host").agg(F.sum("weight").alias("given"))
    taken = onward.groupBy("kind", "to").agg(F.sum("weight").alias("taken"))
    weights = onward.join(given, ["kind", "host"]).join(taken, ["kind", "to"])
    rates = [(F.col("weight") / F.col(c)).alias(c) for c in ("given", "taken")]
    steps = materialize(weights.select("kind", "host", "to", *rates), "steps")
    number = {r["kind"]: r["n"] for r in seeds.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # two rows at most
    base = seeds.select("kind", "host", F.lit(1.0).alias("score"), F.lit(1.0).alias("part"))
    rank = base
    for _ in range(rounds):
        moved = rank.join(steps, ["kind", "host"]).groupBy("kind", "to").agg(
            (damping * F.sum(F.col("score") * F.col("given"))).alias("score"), (damping * F.sum(F.col("part") * F.col("taken"))).alias("part")
        )
        moved = materialize(moved.select("kind", F.col("to").alias("host"), "score", "part"), "moved")
        sums = {r["kind"]: r["s"] for r in moved.groupBy("kind").agg(F.sum("score").alias("s")).collect()}
        if not sums:
            break
        # Each kind holds as much rank as it has seeds: what did not move goes back to them.
        back = F.lit(None).cast("double")
        for kind, n in number.items():
            back = F.when(F.col("kind") == kind, F.lit((n - sums.get(kind, 0.0)) / n)).otherwise(back)
        # No other host's part reaches the 1 of a seed.
        rank = moved.unionByName(base.withColumn("score", back)).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.max("part").alias("part"))
    return rank


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", html: str = "html",
    damping: float = 0.85, least: float = 0.01,
) -> DataFrame:
    """Per page: ``key``, ``host``, ``path``, ``rule``, ``verdict``, and its host's ``trust``, ``distrust`` and parts of both.

    The longest fitting rule decides. For the rest: a host is a trusted (blocked) seed if rules allow (block) more than
    half of its pages. Trust flows from trusted seeds to the hosts that they link; distrust from blocked seeds to the
    hosts that link to them. A host is blocked if its degree-normalised distrust rank ``distrust_part`` is at least
    ``least`` and more than its ``trust_part`` (see :func:`propagate`), so it does not matter how many others link a
    blocked host or how large they are. Rounds go on until no open amount matters for ``least``: a chain of links is
    followed as far as its rank can reach the limit. ``trust`` and ``distrust`` are the ranks without that normalisation.

    A null or malformed url has an empty host and path, fits no rule, and is allowed; such pages give no links. A null
    html has no links; repeated rows each count and give a row; no pages give no rows; further columns are not read.
    Only host pairs and host scores are shuffled; the join of scores to pages splits hot hosts by Spark's skew handling.
    """
    address = F.col(f"`{url}`")
    judged = pages.select(F.col(f"`{key}`").alias("key"), host_of(address).alias("host"), path_of(address).alias("path"))
    judged = judged.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("fit.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    kind = F.when(F.col("allowed") > 0.5, "trust").when(F.col("blocked") > 0.5, "distrust")
    seeds = materialize(hosts.select(kind.alias("kind"), "host").filter("kind is not null"), "seeds")
    rank = propagate(host_links(pages, host_of(address), html), seeds, rounds_for(least, damping), damping)
    columns = {"trust": ("trust", "score"), "distrust": ("distrust", "score"), "trust_part": ("trust", "part"), "distrust_part": ("distrust", "part")}
    scores = rank.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0.0)).alias(name) for name, (k, c) in columns.items()])
    held = {name: F.coalesce(name, F.lit(0.0)) for name in columns}
    bad, good = held["distrust_part"], held["trust_part"]
    method = F.when((bad >= least) & (bad > good), "block").otherwise("allow")
    return judged.join(scores, "host", "left").select(
        F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"),
        *[c.alias(name) for name, c in held.items()],
    )
