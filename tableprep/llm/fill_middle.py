"""Fill-in-middle transformation: texts of a batch are rearranged by displacements of their bytes, and put back by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableprep.llm.text import arrow_map

# The marks before a prefix, a suffix and a middle, all of one size, and the names of the forms.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
MARK = 3
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
# Bytes that are worked on at a time.
BLOCK = 1 << 20

_code = np.arange(256)
LETTER = ((_code >= 0x41) & (_code <= 0x5A)) | ((_code >= 0x61) & (_code <= 0x7A))
BEGINS = (_code & 0xC0) != 0x80  # the first byte of a code point


def blocks(size: int) -> Iterator[tuple[int, int]]:
    for at in range(0, size, BLOCK):
        yield at, min(at + BLOCK, size)


def token_starts(data: np.ndarray, first: np.ndarray, at: int, end: int) -> np.ndarray:
    """Positions in [at, end) at which a token begins: a code point that does not continue a run of ASCII letters.

    ``first``: sorted positions at which a text begins, whatever stands before it.
    """
    part = data[at:end]
    letter = LETTER[part]
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    before[:1] = at > 0 and LETTER[data[at - 1]]
    starts = BEGINS[part] & ~(letter & before)
    starts[first[np.searchsorted(first, at) : np.searchsorted(first, end)] - at] = True
    return np.flatnonzero(starts) + at


def counted(data: np.ndarray, offsets: np.ndarray, starts_of) -> np.ndarray:
    """Number of starts in each text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for at, end in blocks(len(data)):
        spots = starts_of(at, end)
        lo, hi = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end, "left")
        out[lo:hi] += np.diff(np.searchsorted(spots, offsets[lo : hi + 1]))
    return out


def located(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, cuts: np.ndarray, starts_of) -> np.ndarray:
    """Byte position of each text's cut: where its start number ``cuts`` lies, or its end for its number of starts."""
    wanted = np.cumsum(counts) - counts + cuts
    out = offsets[1:].copy()
    inside = np.flatnonzero(cuts < counts)
    ordered = inside[np.argsort(wanted[inside], kind="stable")]
    seen = done = 0
    for at, end in blocks(len(data)):
        spots = starts_of(at, end)
        upto = done + np.searchsorted(wanted[ordered[done:]], seen + len(spots))
        here = ordered[done:upto]
        out[here] = spots[wanted[here] - seen]
        seen, done = seen + len(spots), upto
    return out


def marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and letters of all marks that lie inside a text."""
    spots, letters = [], []
    kinds = np.array([m[1] for m in MARKS.values()], np.uint8)
    for at, end in blocks(len(data)):
        here = np.flatnonzero(data[at:end] == 0x3C) + at
        here = here[here + MARK <= len(data)]
        here = here[(data[here + 2] == 0x3E) & np.isin(data[here + 1], kinds)]
        here = here[here + MARK <= offsets[np.searchsorted(offsets, here, "right")]]
        spots.append(here)
        letters.append(data[here + 1])
    return (np.concatenate(spots), np.concatenate(letters)) if spots else (np.zeros(0, np.int64), np.zeros(0, np.uint8))


def displacements(size: int, places: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Shift of every position, block by block: ``shifts[i]`` holds from ``places[i]`` to the next place.

    The changes of the shift are a difference array, whose cumulative sum gives every position its own. Places are in
    order; of equal ones the last holds.
    """
    change = np.diff(shifts, prepend=0)
    carry = done = 0
    for at, end in blocks(size):
        upto = np.searchsorted(places, end, "left")
        delta = np.zeros(end - at, np.int64)
        np.add.at(delta, places[done:upto] - at, change[done:upto])
        delta[0] += carry
        shift = np.cumsum(delta, out=delta)
        carry, done = int(shift[-1]), upto
        yield at, end, shift


def scatter(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output bytes and offsets: prefix [start, first), middle [first, second) and suffix [second, end) of every text.

    psm: mark, prefix, mark, suffix, mark, middle; spm: mark, suffix, mark, prefix, mark, middle; plain: the text.
    """
    start, end = offsets[:-1], offsets[1:]
    marks = np.where(form == PLAIN, 0, 3 * MARK)
    out_offsets = np.concatenate([[0], np.cumsum(end - start + marks)])
    base = out_offsets[:-1]
    prefix, suffix = first - start, end - second
    # Where the parts begin in the output.
    to_prefix = base + np.select([form == PSM, form == SPM], [MARK, 2 * MARK + suffix], 0)
    to_suffix = base + np.select([form == PSM, form == SPM], [2 * MARK + prefix, MARK], second - start)
    to_middle = base + np.where(form == PLAIN, first - start, 3 * MARK + prefix + suffix)
    places = np.stack([start, first, second], 1).ravel()
    shifts = np.stack([to_prefix - start, to_middle - first, to_suffix - second], 1).ravel()
    out = np.empty(int(out_offsets[-1]), np.uint8)
    for at, stop, shift in displacements(len(data), places, shifts):
        shift += np.arange(at, stop)
        out[shift] = data[at:stop]
    made = form != PLAIN
    for name, to in (("prefix", to_prefix), ("suffix", to_suffix), ("middle", to_middle)):
        for i, byte in enumerate(MARKS[name]):
            out[to[made] - MARK + i] = byte
    return out, out_offsets


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that :func:`scatter` rearranged, from its output and the forms alone: the inverse of the shifts.

    The three marks of a rearranged text are found in its bytes; a text that holds them itself is always plain.
    """
    start, end = offsets[:-1], offsets[1:]
    made = form != PLAIN
    spots, letters = marked(data, offsets)
    row = np.searchsorted(offsets, spots, "right") - 1
    spots, letters, row = spots[made[row]], letters[made[row]], row[made[row]]
    if not np.array_equal(np.bincount(row, minlength=len(form)), np.where(made, 3, 0)):
        raise ValueError("A rearranged text has three marks")
    at = {}
    for name, mark in MARKS.items():
        found = start.copy()
        found[row[letters == mark[1]]] = spots[letters == mark[1]] + MARK
        at[name] = found
    # A part ends where the next mark begins.
    prefix = np.select([form == PSM, form == SPM], [at["suffix"] - MARK, at["middle"] - MARK], end) - at["prefix"]
    suffix = np.select([form == PSM, form == SPM], [at["middle"] - MARK, at["prefix"] - MARK], 0) - np.where(made, at["suffix"], 0)
    middle = np.where(made, end - at["middle"], 0)
    back = np.concatenate([[0], np.cumsum(prefix + middle + suffix)])
    base = back[:-1]
    places = np.stack([base, base + prefix, base + prefix + middle], 1).ravel()
    shifts = np.stack([at["prefix"] - base, at["middle"] - base - prefix, at["suffix"] - base - prefix - middle], 1).ravel()
    out = np.empty(int(back[-1]), np.uint8)
    for lo, stop, shift in displacements(len(out), places, shifts):
        shift += np.arange(lo, stop)
        out[lo:stop] = data[shift]
    return out, back


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts and the offsets of its rows from 0; null is empty."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null(b"")
    size = np.int64 if pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], size)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    values = texts.buffers()[2]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def seed(key: Column) -> Column:
    """Four numbers of 32 bits: the first groups of the SHA-256 of ``1:`` and the key's text; a null key has none."""
    text = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(text, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """``key``, ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` (binary) of every whole text.

    Tokens are runs of ASCII letters and single other code points. The key's hash cuts a text after one token number and
    another, both drawn from 0 to n, and picks the form: of 100 texts ``plain_share`` stay as they are, as do empty texts
    and those that hold a mark; of 100 others ``spm_share`` begin with the suffix, the rest with the prefix.

    A batch's texts lie one after another in one array of bytes. A scan finds the cuts' positions; the shift that each
    byte needs is constant between cuts, so a difference array and its cumulative sum give it for every byte, and one
    scatter writes all outputs. The work goes block by block, so memory is some three times a batch's texts, however
    long one is. Nothing is shuffled.

    A null text is empty; a null key is hashed as no text; repeated rows are cut alike; an empty table gives no rows;
    further columns are not read. Counts of parts are null for plain texts.
    """
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = packed(b["text"].cast(pa.binary()))
            lists = b["seed"]
            h = lists.flatten().to_numpy().reshape(-1, 4)
            tokens = lambda lo, hi: token_starts(data, offsets[:-1], lo, hi)
            chars = lambda lo, hi: np.flatnonzero(BEGINS[data[lo:hi]]) + lo
            n = counted(data, offsets, tokens)
            one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            first = located(data, offsets, n, np.minimum(one, two), tokens)
            second = located(data, offsets, n, np.maximum(one, two), tokens)
            form = np.where(h[:, 3] % 100 < spm_share, SPM, PSM)
            form[(np.diff(offsets) == 0) | (h[:, 2] % 100 >= 100 - plain_share)] = PLAIN
            form[np.searchsorted(offsets, marked(data, offsets)[0], "right") - 1] = PLAIN
            out, ends = scatter(data, offsets, first, second, form)
            parts = np.append(np.stack([offsets[:-1], first, second], 1).ravel(), offsets[-1])
            sizes = counted(data, parts, chars).reshape(-1, 3)
            plain = form == PLAIN
            yield pa.RecordBatch.from_arrays(
                [
                    b["key"], pa.array(n), pa.array(FORMS[form]), pa.array(sizes[:, 0], mask=plain), pa.array(sizes[:, 1], mask=plain),
                    column(out, ends).cast(pa.binary()),
                ],
                ["key", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    fields = f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"
    made = arrow_map(docs, {"key": key, "text": text, "seed": seed(F.col(f"`{key}`"))}, work, fields)
    return made.withColumnRenamed("key", key)


def restore(made: DataFrame, keep: list[str], output: str = "output", form: str = "form") -> DataFrame:
    """Columns ``keep`` and ``restored`` (binary): the exact texts, from outputs and forms alone.

    Null outputs are empty; a null form is plain; other rows as :func:`fill_in_middle`. An output that lacks one of its
    form's marks, or repeats one, is an error.
    """
    names = {f"keep_{i}": c for i, c in enumerate(keep)}
    types = ", ".join(f"{k} {made.schema[c].dataType.simpleString()}" for k, c in names.items())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = packed(b["output"].cast(pa.binary()))
            out, ends = gather(data, offsets, b["form"].to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[b[k] for k in names], column(out, ends).cast(pa.binary())], [*names, "restored"])

    number = F.when(F.col(form) == "psm", PSM).when(F.col(form) == "spm", SPM).otherwise(PLAIN)
    out = arrow_map(made, {**names, "output": output, "form": number}, work, f"{types}, restored binary")
    return out.select(*[F.col(k).alias(c) for k, c in names.items()], "restored")
