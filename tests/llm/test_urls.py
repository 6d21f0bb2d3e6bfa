"""Hosts, rules and propagation against plain versions."""

import random

import numpy as np
import pytest

from emberline.llm import queries, urls


def test_judged(spark):
    bad = '<a href="http://spam.net/x">x</a><A HREF=//Spam.net>y</A><a href="mailto:a@b">z</a>'
    rows = [
        (1, "https://WWW.Example.org/es/1?x", None), (2, "http://example.org/en/12", ""), (3, "http://a.org", ""), (4, "http://a.org/", ""), (5, None, bad), (6, "no scheme", bad),
        (7, "http://spam.com/de/1", ""), (8, "http://spam.com/en", ""), (9, "http://friend.net/q#f", '<a href="http://spam.com/de/">b</a>'), (10, "http://myorg/es/", ""), (11, "x://h?://y/z", ""), (11, "x://h?://y/z", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judged(df, queries.URL_RULES).collect())
    assert found == [
        (1, "www.example.org", "/es/1", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "a.org", "", None, "allow"), (4, "a.org", "/", "org/", "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "spam.com", "/de/1", "com/de/", "block"), (8, "spam.com", "/en", None, "block"), (9, "friend.net", "/q", None, "block"),
        (10, "myorg", "/es/", None, "allow"), (11, "h", "", None, "allow"), (11, "h", "", None, "allow"),
    ]
    assert urls.judged(df.limit(0), queries.URL_RULES).count() == 0


def solved(edges, seeds):
    """Textbook personalised PageRank: rows without links lead to the seeds; the linear system is solved."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts),) * 2)
    for (a, b), n in edges.items():
        m[at[a], at[b]] += n
    s = np.array([float(seeds.get(h, 0)) for h in hosts])
    m[~m.any(axis=1)] = s
    m /= m.sum(axis=1, keepdims=True)
    x = np.linalg.solve(np.eye(len(hosts)) - urls.DAMPING * m.T, (1 - urls.DAMPING) * s)
    return {h: x[i] for h, i in at.items() if x[i] > 1e-6}


def returned(spark, edges, seeds, **options):
    frame = spark.createDataFrame([("k", a, b, n) for (a, b), n in edges.items()], "kind string, src string, dst string, n long")
    found = urls.returned(frame, spark.createDataFrame([("k", h, m) for h, m in seeds.items()], "kind string, host string, mass long"), **options)
    return {r.host: r.score for r in found.collect() if r.score > 1e-6}


def test_dangling_mass_returns(spark):
    # two links to a host without links, and a seed that has none
    edges, seeds = {("a", "end"): 1, ("a", "b"): 1, ("b", "end"): 2}, {"a": 3, "lone": 1}
    assert returned(spark, edges, seeds, tolerance=2e-7) == pytest.approx(solved(edges, seeds), abs=1e-6)


def test_random_graphs(spark):
    rng = random.Random(4)
    edges = {(f"h{rng.randrange(12)}", f"h{rng.randrange(15)}"): rng.randint(1, 5) for _ in range(40)}
    seeds = {"h1": 3, "h5": 1, "lone": 2}
    assert returned(spark, edges, seeds, tolerance=2e-7) == pytest.approx(solved(edges, seeds), abs=1e-6)


def test_longest_rule_and_normalised_seeds(spark):
    """The whole rule's length counts. One blocked page against nine trusted ones: each side has a mass of 1."""
    rows = [(1, "http://x.b.org/long/path", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert urls.judged(df, [("x.b.org/", "block"), ("b.org/long/path", "allow")]).first().rule == "b.org/long/path"
    rows = [(i, "http://good.net/ok", '<a href="http://mid.net/">x</a>') for i in range(9)] + [(9, "http://bad.net/no", ""), (10, "http://mid.net/", '<a href="http://bad.net/">x</a>'), (11, "http://other.net/", "")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "page_id long, url string, html string, HOST string, id int")
    found = {r.page_id: r for r in urls.judged(df, [("good.net/ok", "allow"), ("bad.net/no", "block")]).collect()}
    trust = solved({("good.net", "mid.net"): 9, ("mid.net", "bad.net"): 1}, {"good.net": 1})
    distrust = solved({("mid.net", "good.net"): 9, ("bad.net", "mid.net"): 1}, {"bad.net": 1})
    for r in found.values():
        assert (r.trust, r.distrust) == pytest.approx((trust.get(r.host, 0), distrust.get(r.host, 0)), abs=2e-6)
    assert found[10].verdict == "allow" and found[11].verdict == "allow" and found[9].verdict == "block"


def test_long_chains_converge(spark):
    edges = {(f"c{i}", f"c{i + 1}"): 1 for i in range(40)} | {("c40", "c38"): 1, ("x", "y"): 2, ("y", "x"): 1, ("y", "c0"): 3}
    seeds = {"c0": 900, "x": 100}
    expected = solved(edges, seeds)
    assert len(expected) == 43 and returned(spark, edges, seeds, tolerance=2e-7) == pytest.approx(expected, abs=1e-6)


def test_far_host_is_blocked(spark):
    link = lambda i: f'<a href="http://c{i}.net/">x</a>'
    rows = [(i, f"http://c{i}.net/", link(i + 1)) for i in range(13)] + [(13, "http://c13.net/", ""), (14, "http://c13.net/bad", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.verdict for r in urls.judged(df, [("c13.net/bad", "block")]).collect()} == {"block"}
