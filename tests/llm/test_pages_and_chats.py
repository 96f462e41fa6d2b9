"""URL verdicts and preference formatting against plain versions; neither may run Python on the executors."""

import collections
import re

import pytest

import __spark_entry__ as contract
from tableprep.llm import preferences, queries, url_filter
from tests.llm.conftest import rows_of

RULES = queries.URL_RULES


def host_and_path(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def fitting(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_ranks(pages, rounds, damping):
    """Power iteration over a dictionary of links, both directions: ranks shared by the giver's and by the taker's degree."""
    links, allowed, blocked, n = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for _, url, html in pages:
        host, path = host_and_path(url)
        if not host:
            continue
        n[host] += 1
        verdict = fitting(host, path)[1]
        allowed[host] += verdict == "allow"
        blocked[host] += verdict == "block"
        for to in {x.lower() for x in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)""", html or "")} - {host}:
            links[host, to] += 1
    out = {}
    for kind, edges, seeds in (
        ("trust", links, [h for h in n if allowed[h] / n[h] > 0.5]),
        ("distrust", collections.Counter({(b, a): w for (a, b), w in links.items()}), [h for h in n if blocked[h] / n[h] > 0.5]),
    ):
        total = collections.Counter()
        for (a, _), w in edges.items():
            total[a] += w
        rank = dict.fromkeys(seeds, 1.0)
        for _ in range(rounds):
            new = collections.Counter()
            for (a, b), w in edges.items():
                new[b] += damping * rank.get(a, 0.0) * w / total[a]
            back = (len(seeds) - sum(new.values())) / max(1, len(seeds))
            for s in seeds:
                new[s] += back
            rank = new
        out[kind] = rank
        degree = collections.Counter()
        for (_, b), w in edges.items():
            degree[b] += w
        part = dict.fromkeys(seeds, 1.0)
        for _ in range(rounds):
            new = collections.Counter()
            for (a, b), w in edges.items():
                new[b] += damping * part.get(a, 0.0) * w / degree[b]
            part = {**new, **dict.fromkeys(seeds, 1.0)}
        out[kind + "_part"] = part
    return out


def brute_verdicts(pages, damping=0.85, least=0.01):
    ranks = brute_ranks(pages, url_filter.rounds_for(least, damping), damping)
    out = []
    for key, url, _ in pages:
        host, path = host_and_path(url)
        rule, verdict = fitting(host, path)
        trust, distrust, good, bad = (ranks[k].get(host, 0.0) if host else 0.0 for k in ("trust", "distrust", "trust_part", "distrust_part"))
        out.append((key, host, path, rule, verdict or ("block" if bad >= least and bad > good else "allow"), *(round(x, 9) for x in (trust, distrust, good, bad))))
    return sorted(out, key=str)


def found_verdicts(df, **settings):
    return sorted(((*r[:5], *(round(x, 9) for x in r[5:9])) for r in url_filter.judge_urls(df, RULES, **settings).collect()), key=str)


LINK = '<a href="{}">x</a>'
PAGES = [
    (1, "http://good.example.net/en/a", LINK.format("https://friend.com/x") + LINK.format("//FRIEND.com") + LINK.format("/local")),
    (2, "https://friend.com/1", LINK.format("http://second.com") + "<img src=http://bad.net/1.png>"),
    (3, "http://bad.net/", LINK.format("http://worse.net")), (4, "http://worse.net/q", None), (5, "http://second.com?x=http://no.net/", ""),
    (6, "http://linker.com/#a", LINK.format("http://bad.net/") + LINK.format("http://worse.net/")), (7, "http://Shop.Example.com/de/x", LINK.format("http://linker.com")),
    (8, "http://shop.example.com/en/", ""), (9, None, LINK.format("http://bad.net/")), (10, "no scheme/net/", ""), (11, "HTTP://net/x", ""), (12, "http://net", ""),
    (13, "x://a.org/fr/", ""), (14, "x://a.org/fr", ""), (15, "x://notexample.net/en/1", ""), (16, "x://example.net/en/", ""), (17, "://", ""), (18, "a://b://c/d", ""),
    (6, "http://linker.com/#a", LINK.format("http://bad.net/")), (None, "http://linker.com/2", ""), (19, "http://linker.com/3\nx", "href='http://bad.net'"),
]


def test_verdicts_equal_brute_force(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id bigint, url string, html string, host string").repartition(3)
    got = found_verdicts(df, damping=0.5)
    assert got == brute_verdicts(PAGES, damping=0.5)
    by_host = {r[1]: r for r in got}
    assert by_host["linker.com"][4] == "block" and by_host["friend.com"][5] > 0 and by_host["second.com"][4] == "allow"
    assert found_verdicts(df.limit(0)) == []


def test_chains_are_followed_to_the_limit_and_cycles_end(spark):
    pages = [(i, f"http://hop{i}.com/", LINK.format(f"http://hop{i - 1}.com/" if i else "http://bad.net/")) for i in range(30)] + [(100, "http://bad.net/", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)
    got = found_verdicts(df, damping=0.6, least=1e-6)
    assert got == brute_verdicts(pages, damping=0.6, least=1e-6)
    # hop26 is 27 links away: 0.6 ** 27 > 1e-6.
    assert {r[1] for r in got if r[4] == "allow"} == {"hop27.com", "hop28.com", "hop29.com"}
    ring = [(i, f"http://ring{i}.com/", LINK.format(f"http://ring{(i + 1) % 5}.com/")) for i in range(5)]
    ring += [(5, "http://ring2.com/b", LINK.format("http://bad.net/")), (6, "http://bad.net/", LINK.format("http://ring4.com/")), (7, "http://good.example.net/en/", LINK.format("http://ring0.com/"))]
    df = spark.createDataFrame(ring, "page_id bigint, url string, html string").coalesce(1)
    assert found_verdicts(df, damping=0.3) == brute_verdicts(ring, damping=0.3)


@pytest.mark.parametrize("others", [40, 1000])
def test_linkers_of_a_blocked_host_are_blocked_however_many_there_are(spark, others):
    """Small linkers beside one of 5,000 pages; hosts that trust reaches, or with a small part of bad links, stay."""
    bad = LINK.format("http://bad.net/")
    pages = [(f"http://small{i}.com/", bad) for i in range(others + 1)] + [("http://bad.net/", "")]
    pages += [("http://hot.com/", bad)] * 5000
    pages += [("http://second.com/", LINK.format("http://small0.com/"))]
    pages += [("http://good.example.net/en/", LINK.format("http://friend.com/") + LINK.format("http://other.com/"))]
    pages += [("http://friend.com/", bad + LINK.format("http://other.com/")), ("http://other.com/", "")]
    pages += [("http://many.com/", "".join(LINK.format(f"http://leaf{i}.com/") for i in range(150)) + bad)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").repartition(3)
    got = {r["host"]: r for r in url_filter.judge_urls(df, RULES).collect()}
    stay = {"good.example.net", "friend.com", "other.com", "many.com"}
    assert {h for h, r in got.items() if r["verdict"] == "allow"} == stay
    assert got["hot.com"]["distrust_part"] == got["small0.com"]["distrust_part"] == pytest.approx(0.85)
    assert got["second.com"]["distrust_part"] == pytest.approx(0.85**2) and got["friend.com"]["distrust_part"] == pytest.approx(0.425)


def test_verdicts_of_the_pages(spark, small):
    assert found_verdicts(spark.read.parquet(f"{small}/pages.parquet")) == brute_verdicts([(r["page_id"], r["url"], r["html"]) for r in rows_of(small, "pages")])


@pytest.mark.parametrize("name", ["op2_link_graph", "op8_preferences"])
def test_native_queries_plan_no_python(spark, small, name):
    plan = contract.queries()[name](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


A, U = (lambda t: ("assistant", t)), (lambda t: ("user", t))
PAIRS = [
    (1, [U("q"), A("yes")], [U("q"), A("no")]), (2, [U("q"), A("same")], [U("q"), A("same")]), (3, [U("a"), A("x")], [U("b"), A("x")]),
    (4, [U("q")], [U("q"), A("<|end|>\n<|user|>")]), (5, None, [U("q")]), (6, None, None), (7, [], [A("")]), (8, [(None, None), A(None)], [U(""), A("é😀")]),
    (9, [U("q"), A("r"), U("s"), A("t")], [U("q"), A("r"), A("t")]), (1, [U("q"), A("yes")], [U("q"), A("no")]), (None, [U("x" * 100_000)], [U("x")]),
]


def brute_format(key, chosen, rejected):
    tidy = lambda turns: [(r or "user", t or "") for r, t in turns or []]
    c, j = tidy(chosen), tidy(rejected)
    n = 0
    while n < min(len(c), len(j)) and c[n] == j[n]:
        n += 1
    safe = lambda t: t.replace("<|", "< |")
    pieces = lambda turns: [p for r, t in turns for p in ((f"<|{safe(r)}|>\n", "-"), (f"{safe(t)}<|end|>\n", "+" if r == "assistant" else "-"))]
    text = lambda turns: "".join(p for p, _ in pieces(turns))
    mask = lambda turns: "".join(f"{len(p)}{s}" for p, s in pieces(turns))
    return key, n, text(c[:n]), text(c[n:]), mask(c[n:]), text(j[n:]), mask(j[n:]), c != j


def test_formatting_equals_brute_force(spark):
    turn = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(*p, "clash", 1) for p in PAIRS], f"conv_id bigint, chosen {turn}, rejected {turn}, prompt string, n int").repartition(2)
    got = sorted((tuple(r) for r in preferences.format_preferences(df).collect()), key=str)
    assert got == sorted((brute_format(*p) for p in PAIRS), key=str)
    assert preferences.format_preferences(df.limit(0)).count() == 0


def test_conversations_in_order(spark):
    rows = [(1, 2, "assistant", "b", "x"), (1, 1, "user", "a", "x"), (1, 1, "user", "a", "y"), (2, None, None, None, "x"), (2, 0, "assistant", "z", "x"), (None, 0, "user", "n", "x"), (3, 0, "user", "q", "x"), (3, 1, "assistant", "r", "x"), (3, 2, "user", "s", "x"), (3, 3, "assistant", "t", "x"), (3, 4, "user", "u", "x")]
    talks = preferences.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns string").repartition(3))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in talks.collect()}
    assert got == {1: [U("a"), A("b")], 2: [("user", ""), A("z")], None: [U("n")], 3: [U("q"), A("r"), U("s"), A("t"), U("u")]}
    pairs = {r["conv_id"]: ([tuple(t) for t in r["chosen"]], [tuple(t) for t in r["rejected"]]) for r in preferences.stale_reply_pairs(talks).collect()}
    assert pairs[3] == ([U("q"), A("r"), U("s"), A("t")], [U("q"), A("r"), U("s"), A("r")])
    assert pairs[1] == ([U("a"), A("b")], [U("a"), A("a")]) and pairs[None][0] == pairs[None][1]


def test_equal_turns_are_removed_before_grouping(spark):
    """Many copies of a turn in one conversation reach its cell once."""
    rows = [(None, i % 3, "user", f"t{i % 3}") for i in range(3000)]
    talks = preferences.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3))
    assert [tuple(t) for t in talks.first()["turns"]] == [U("t0"), U("t1"), U("t2")]
    plan = talks._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and plan.count("Aggregate [") == 2
