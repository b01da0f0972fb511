"""URL rules and host reputation: cut urls, tails, posterior verdicts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from slatewright.llm import urlfilter
from slatewright.llm.queries import URL_RULES


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("http://WWW.Example.com/en/x?q=/y#z", "www.example.com", "/en/x", "www.example.com/en/"),
    ("https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/"),
    ("https://example.com/en", "example.com", "/en", "com/"),
    ("ftp://com/", "com", "/", "com/"), ("http://a.com", "a.com", "", None), ("http://a.com?x=/y", "a.com", "", None),
    ("http://b.net/fr/1", "b.net", "/fr/1", "net/fr/"), ("http://bnet/fr/1", "bnet", "/fr/1", None),
    ("http://x.org/a://b", "x.org", "/a://b", None), ("//x.com/", "", "", None), ("", "", "", None), (None, "", "", None),
    ("http://ÄB.com:80/é", "Äb.com:80", "/é", None), ("a b://", "", "", None)])
def test_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url, "x")], "page_id bigint, url string, rule string")
    none = spark.createDataFrame([], "page_id bigint, bad int")
    got = urlfilter.judge(pages, none, URL_RULES).collect()
    verdict = next((r.verdict for r in URL_RULES if r.text == rule), "allow")
    assert [tuple(r) for r in got] == [(1, host, path, rule, verdict)]


def test_domains(spark):
    hosts = {"news.bbc.co.uk": ("bbc.co.uk", "co.uk"), "a.b.example.com": ("example.com", "com"), "u@x.org.:8080": ("x.org", "org"),
             "10.1.2.3": ("10.1.2.3", "3"), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r[0]: (r[1], r[2]) for r in df.select("host", urlfilter.domain_of(F.col("host")), urlfilter.suffix_of(F.col("host"))).collect()}
    assert got == hosts


def test_tail_against_sums(spark):
    """For whole numbers, P(rate > x) is a binomial sum."""
    from math import comb

    cases = [(a, b, x) for a in (1, 2, 7, 40) for b in (1, 3, 25, 90) for x in (0.05, 0.3, 0.5, 0.9)]
    for x in {c[2] for c in cases}:
        own = [(a, b) for a, b, y in cases if y == x]
        df = spark.createDataFrame([(float(a), float(b)) for a, b in own], "a double, b double")
        got = [r[2] for r in df.select("a", "b", urlfilter.beta_tail(F.col("a"), F.col("b"), x)).collect()]
        for (a, b), tail in zip(own, got, strict=True):
            n = a + b - 1
            assert tail == pytest.approx(sum(comb(n, k) * x ** k * (1 - x) ** (n - k) for k in range(a)), abs=1e-9)


def test_tail_against_integral(spark):
    """Any parameters, by many small steps; and the normal law beyond EXACT_UP_TO gives the same verdicts."""
    import numpy as np

    for a, b, x in [(0.7, 2.4, 0.5), (3.25, 0.6, 0.8), (120.5, 90.25, 0.55), (9000.5, 9100.5, 0.5)]:
        grid = (np.arange(400_000) + 0.5) / 400_000
        logs = (a - 1) * np.log(grid) + (b - 1) * np.log(1 - grid)
        weight = np.exp(logs - logs.max())
        want = weight[grid > x].sum() / weight.sum()
        got = spark.range(1).select(urlfilter.beta_tail(F.lit(a), F.lit(b), x)).first()[0]
        assert got == pytest.approx(want, abs=3e-3)


def pages_of(spark, spec):
    rows = [(i, f"http://{host}/{i}") for i, host in enumerate(h for h, n, _ in spec for _ in range(n))]
    bad = [flag for _, n, k in spec for flag in [1] * k + [0] * (n - k)]
    return (spark.createDataFrame(rows, "page_id bigint, url string"),
            spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "page_id bigint, bad int"))


def test_reputation_borrows_from_domain(spark):
    spec = [(f"h{i}.bad.org", 30, 28) for i in range(8)] + [(f"h{i}.good.org", 30, 1) for i in range(8)] + [
        ("new.bad.org", 1, 1), ("new.good.org", 1, 1), ("alone.net", 1, 1), ("large.good.org", 400, 390)]
    pages, outcomes = pages_of(spark, spec)
    unseen = spark.createDataFrame([(None, "http://unseen.bad.org/"), (None, "http://unseen.good.org/")], pages.schema)
    got = {r.host: r for r in urlfilter.reputation(pages.union(unseen), outcomes).collect()}
    assert all(got[f"h{i}.bad.org"].blocked and not got[f"h{i}.good.org"].blocked for i in range(8))
    assert got["large.good.org"].blocked and got["large.good.org"].rate > 0.9
    assert got["unseen.bad.org"].rate > got["unseen.good.org"].rate + 0.3 and got["unseen.bad.org"].n == 0
    assert got["new.bad.org"].rate > got["alone.net"].rate and not got["new.good.org"].blocked


def test_hot_host_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, "http://hot.org/x") for i in range(2000)] + [(None, None)] * 700 + [(5000 + i, f"http://h{i}.net/") for i in range(2500)]
    rows += [(1, "http://hot.org/x")] * 500
    rng.shuffle(rows)
    pages = spark.createDataFrame([(*r, "y", 1) for r in rows], "page_id bigint, url string, blocked string, n int")
    outcomes = spark.createDataFrame([(i, 1) for i in range(900)] + [(i, 0) for i in range(5000, 7500)] + [(1, 1), (None, 1), (2, None)],
                                     "page_id bigint, bad int")
    got = urlfilter.judge(pages, outcomes, []).collect()
    assert len(got) == len(rows)
    assert {r.verdict for r in got if r.host == "hot.org"} == {"block"} and {r.verdict for r in got if r.host != "hot.org"} == {"allow"}
    n = {r.host: (r.pages, r.n, r.bad) for r in urlfilter.reputation(pages, outcomes).collect()}
    assert n["hot.org"] == (2500, 900 + 1 + 501 * 2 - 2, 900 + 1 + 501 * 2 - 2) and n[""] == (700, 0, 0)


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert urlfilter.judge(empty, spark.createDataFrame([], "page_id bigint, bad int"), URL_RULES).collect() == []
