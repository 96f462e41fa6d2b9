"""Fill-in-middle by displacements against a plain version with slices, and round trips."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tableprep.llm import fill_middle
from tableprep.llm.queries import QUERIES, ORACLES
from tests.llm.conftest import rows_of

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain_version(key, text):
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def shown(rows):
    return sorted(((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], bytes(r["output"]).decode()) for r in rows), key=str)


def expected(rows):
    return sorted(((str(k), *plain_version(k, t)) for k, t in rows), key=str)


def test_query_equals_plain_version(spark, small):
    got = {r["doc_id"]: r for r in QUERIES["op12_displacement"](spark, small).collect()}
    docs = rows_of(small, "documents")
    assert len(got) == len(docs) and {r["form"] for r in got.values()} == {"plain", "psm", "spm"}
    for d in docs:
        n, form, prefix, middle, output = plain_version(d["doc_id"], d["text"])
        r = got[d["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


def test_odd_rows_and_nothing(spark, odd, nothing):
    made = fill_middle.fill_in_middle(odd)
    source = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert shown(made.collect()) == expected(source)
    back = fill_middle.restore(made, ["doc_id"]).collect()
    assert sorted((str(r["doc_id"]), bytes(r["restored"]).decode()) for r in back) == sorted((str(k), t or "") for k, t in source)
    assert fill_middle.fill_in_middle(nothing).collect() == [] == fill_middle.restore(fill_middle.fill_in_middle(nothing), ["doc_id"]).collect()


@pytest.mark.parametrize("block", [1, 2, 5, 64, 1 << 20])
def test_blocks_of_any_size(spark, monkeypatch, block):
    """Cuts, marks, letters runs and code points across the ends of blocks and texts."""
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    rng = random.Random(block)
    parts = ["a", "bc", "<", "P", ">", "<P", "<S>", "S>", "é", "😀", "\0", " ", "\n", "Zz", "M", "<M"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 0, 1, 2, 5, 20]))) for _ in range(120)] + ["", ""]
    data, offsets = fill_middle.packed(pa.array([t.encode() for t in texts], pa.binary()))
    tokens = lambda lo, hi: fill_middle.token_starts(data, offsets[:-1], lo, hi)
    n = fill_middle.counted(data, offsets, tokens)
    assert n.tolist() == [len(TOKEN.findall(t)) for t in texts]
    cuts = np.array([sorted((rng.randint(0, k), rng.randint(0, k))) for k in n])
    first, second = (fill_middle.located(data, offsets, n, cuts[:, i], tokens) for i in (0, 1))
    form = np.array([0 if not t or re.search("<[PSM]>", t) else rng.choice([0, 1, 2]) for t in texts])
    holds = np.searchsorted(offsets, fill_middle.marked(data, offsets)[0], "right") - 1
    assert sorted(set(holds.tolist())) == [i for i, t in enumerate(texts) if re.search("<[PSM]>", t)]
    out, ends = fill_middle.scatter(data, offsets, first, second, form)
    outputs = [bytes(out[a:b]).decode() for a, b in zip(ends, ends[1:])]
    for text, f, (a, b), output in zip(texts, form, cuts, outputs):
        u = TOKEN.findall(text)
        prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        assert output == [text, f"<P>{prefix}<S>{suffix}<M>{middle}", f"<S>{suffix}<P>{prefix}<M>{middle}"][f]
    back, back_ends = fill_middle.gather(out, ends, form)
    assert [bytes(back[a:b]).decode() for a, b in zip(back_ends, back_ends[1:])] == texts


def test_outputs_that_lack_a_mark():
    data, offsets = fill_middle.packed(pa.array([b"<P>a<S>b"], pa.binary()))
    with pytest.raises(ValueError):
        fill_middle.gather(data, offsets, np.array([fill_middle.PSM]))


def test_slices_and_nulls_of_a_batch():
    texts = pa.array([b"ab", None, b"", b"cd"], pa.binary())
    data, offsets = fill_middle.packed(texts.slice(1))
    assert bytes(data) == b"cd" and offsets.tolist() == [0, 0, 0, 2]


def test_query_has_sql():
    assert "op12_displacement" in ORACLES
