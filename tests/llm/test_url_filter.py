import random
from datetime import datetime, timedelta

import pytest

from keystead.llm import url_filter

START = datetime(2024, 1, 1)


def keys(url):
    import re
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    host = m[1].lower() if m else ""
    if not host:
        return []
    s = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", url)
    labels = host.split(".")
    return [f"path:{host}/{s[1] if s else ''}", f"host:{host}"] + [f"domain:{'.'.join(labels[i:])}" for i in range(len(labels))]


def brute(captures, entries):
    out = []
    for i, url, at in captures:
        verdict = ("none", None, None)
        for key in keys(url) if at else []:
            past = [(d, e, a) for e, k, r, a, d in entries if r and k and a and d and f"{k}:{r.lower()}" == key and d <= at]
            if past and max(past)[2] in ("block", "allow"):
                verdict = (max(past)[2], key, max(past)[0])
                break
        out.append((i, *verdict))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["page_id"], r["verdict"], r["rule"], r["since"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def frames(spark):
    def make(captures, entries):
        c = spark.createDataFrame([(*r, "x") for r in captures], "page_id long, url string, fetched_at timestamp_ntz, key string")
        e = spark.createDataFrame([(*r, 1) for r in entries], "entry_id long, kind string, rule string, action string, dated timestamp_ntz, day int")
        return c, e
    return make


def test_random_lists(frames):
    rng = random.Random(4)
    hosts = ["a.example", "www.a.example", "b.example", "x.y.b.example"]
    rule = {"host": lambda: rng.choice(hosts), "domain": lambda: rng.choice(["a.example", "example", "b.example", "y.b.example"]), "path": lambda: rng.choice(hosts) + "/" + rng.choice(["en", "de", ""])}
    at = lambda: START + timedelta(hours=rng.randint(0, 24 * 12), minutes=rng.choice([0, 0, 17]))
    entries = [(i, k := rng.choice(list(rule)), rule[k](), rng.choice(["block", "allow", "remove"]), at()) for i in range(300)]
    entries += [(900, "host", None, "block", START), (901, None, "a.example", "block", START), (902, "host", "a.example", "block", None), (903, "host", "a.example", None, START)]
    captures = [(i, rng.choice(["http://", "HTTPS://u:p@"]) + rng.choice(hosts).upper() + rng.choice(["", ":80", "/", "/en/x?q", "/de", "/en#t", "?a=/en"]), at()) for i in range(800)]
    captures += [(2000, None, START), (2001, "http://a.example/", None), (2002, "no url", START), (5, captures[5][1], captures[5][2])]
    c, e = frames(captures, entries)
    assert result(url_filter.evaluate(c, e)) == brute(captures, entries)


def test_boundaries_and_ties(frames):
    day = START + timedelta(days=1)
    entries = [(1, "host", "h.example", "block", day), (2, "host", "h.example", "remove", day + timedelta(hours=1)), (3, "domain", "example", "allow", day + timedelta(hours=1)), (4, "domain", "example", "block", day + timedelta(hours=1))]
    captures = [(i, "http://h.example/", day + timedelta(seconds=s)) for i, s in enumerate([-1, 0, 3599, 3600, 90_000])]
    out = {r[0]: r[1] for r in result(url_filter.evaluate(*frames(captures, entries)))}
    assert out == {0: "none", 1: "block", 2: "block", 3: "block", 4: "block"}
    assert result(url_filter.evaluate(*frames(captures, entries))) == brute(captures, entries)
    assert [r["page_id"] for r in url_filter.kept(*frames(captures, entries)).collect()] == [0]


def test_empty_tables(frames):
    c, e = frames([(1, "http://a.example/", START)], [])
    assert result(url_filter.evaluate(c, e)) == [(1, "none", None, None)]
    assert url_filter.evaluate(*frames([], [(1, "host", "a", "block", START)])).count() == 0
