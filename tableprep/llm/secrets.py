"""Secret scans: pattern spans, and weak parts of a credential that count only beside their complement."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tableprep.llm.text import arrow_map, numbered, restored
from tableprep.plans.scratch import materialize

# The kinds in their order, the patterns of the three strong kinds and the weak parts.
KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ACCOUNT = re.compile(
    r"""(?<![A-Za-z0-9])(?:client_?id|access_?key_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+]{1,15}://[A-Za-z0-9.-]+(?::[0-9]{1,5})?", re.ASCII)
# What a kind stands for: an access identifier, a secret or an endpoint. Weak kinds need another role nearby.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "account": "id", "opaque": "secret", "endpoint": "endpoint"}
WEAK = ("account", "opaque", "endpoint")
SPAN = "struct<start:bigint,ord:int,end:bigint>"


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of all matches, strong and weak, leftmost and non-overlapping in each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    taken = sorted((s, e) for s, _, e in found)
    weak = [(m.start(), k, m.end()) for k, p in ((3, ACCOUNT), (4, OPAQUE), (5, ENDPOINT)) for m in _weak(p, k, text)]
    if weak and taken:  # a weak part inside a strong span says nothing more
        starts = [s for s, _ in taken]
        reach = _furthest(taken)
        weak = [w for w in weak if not _covered(w, starts, reach)]
    return sorted(found + weak)


def _weak(pattern: re.Pattern, kind: int, text: str) -> Iterator[re.Match]:
    if kind == 5 and "://" not in text or kind == 3 and "=" not in text and ":" not in text:
        return iter(())
    return pattern.finditer(text)


def _furthest(taken: list[tuple[int, int]]) -> list[int]:
    out, far = [], 0
    for _, e in taken:
        far = max(far, e)
        out.append(far)
    return out


def _covered(w: tuple[int, int, int], starts: list[int], reach: list[int]) -> bool:
    before = bisect_left(starts, w[2])
    return before > 0 and reach[before - 1] > w[0]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("ord", pa.int32()), ("end", pa.int64())]))
    for b in batches:
        spans = [[{"start": s, "ord": k, "end": e} for s, k, e in pattern_spans(t or "")] for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*[b[c] for c in b.schema.names if c != "text"], pa.array(spans, kind)], [*[c for c in b.schema.names if c != "text"], "spans"])


def linked_spans(docs: DataFrame, keep: list[str], text: str = "text", scope: int = 300) -> DataFrame:
    """Columns ``keep`` and ``spans``: all strong spans and the weak ones whose complement lies within ``scope`` characters.

    A weak part (an account name, an opaque mixed string, an address) is reported only if a part of another role, weak
    or strong, begins or ends within ``scope`` code points of it; of two weak parts at least one of the pair must be
    able to be the secret. Each such pair is found by an interval join on scopes: parts are binned by their position
    divided by ``scope`` and each bin and role is reduced to its first start and last end before the join, so that a
    weak part meets at most three rows of a role, however many parts a text holds.

    Null and empty texts have no spans; repeated documents each give a row; no documents give no rows. Columns besides
    ``keep`` and ``text`` are not read.
    """
    names = {f"keep_{i}": c for i, c in enumerate(keep)}
    source = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()], F.col(f"`{text}`").alias("text"))
    types = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in names)
    found = materialize(
        arrow_map(source, {c: c for c in source.columns}, _scan, f"{types}, spans array<{SPAN}>").withColumn("row", F.expr("uuid()")), "spans"
    )
    role = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLES[k])]), F.col("part.ord"))
    parts = found.filter(F.exists("spans", lambda s: s["ord"] >= 3)).select("row", F.explode("spans").alias("part"))
    parts = parts.withColumns({"role": role, "bin": F.floor(F.col("part.start") / scope)})
    ends = F.floor((F.col("part.end") - 1) / scope)
    # A part is known in each bin that it reaches into.
    bounds = (
        parts.withColumn("bin", F.explode(F.sequence("bin", F.greatest(ends, F.col("bin")))))
        .groupBy("row", "role", "bin").agg(F.min("part.start").alias("first"), F.max("part.end").alias("last"))
    )
    weak = parts.filter(F.col("part.ord") >= 3).withColumn("near", F.explode(F.sequence(F.col("bin") - 1, F.greatest(ends, F.col("bin")) + 1)))
    other = bounds.select("row", F.col("role").alias("other_role"), F.col("bin").alias("near"), "first", "last")
    paired = (
        weak.join(other, ["row", "near"])
        .filter("other_role <> role and (role = 'secret' or other_role = 'secret')")
        .filter((F.col("first") <= F.col("part.end") + scope) & (F.col("last") >= F.col("part.start") - scope))
        .select("row", "part").distinct()
        .groupBy("row").agg(F.collect_list("part").alias("linked"))
    )
    paired = materialize(paired, "linked")  # its true size decides how it is joined to the rows
    strong = F.filter("spans", lambda s: s["ord"] < 3)
    none = F.array().cast(f"array<{SPAN}>")
    return found.join(paired, "row", "left").select(
        *[F.col(k).alias(c) for k, c in names.items()],
        strong.alias("base"),
        F.array_sort(F.concat(strong, F.coalesce("linked", none))).alias("spans"),
    )


def as_text(spans: str):
    """``kind:start:end`` of spans ordered by start, then kind, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", scope: int = 300, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of :func:`linked_spans` replaced by ``mark``, overlapping spans by one; all rows stay.

    A column ``length``, if there is one, becomes the number of code points of a changed text. Null texts stay null.
    """
    source, names = numbered(docs)
    found = linked_spans(source, source.columns, names[text], scope)
    place, size = names[text], names.get(length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = {c: b[c] for c in names.values()}
            spans = b["spans"].to_pylist()
            new = [_struck(t, s, mark) if s else t for t, s in zip(b[place].to_pylist(), spans)]
            cells[place] = pa.array(new, b[place].type)
            if size:
                cells[size] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, b[size].to_pylist())], b[size].type)
            yield pa.RecordBatch.from_arrays(list(cells.values()), list(cells))

    types = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in names.values())
    return restored(arrow_map(found, {c: c for c in found.columns}, work, types), names)


def _struck(text: str, spans: list[dict[str, int]], mark: str) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])
