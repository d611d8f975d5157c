import re

import pytest
from fixtures import dicts

from tallyforge.llm.url_filter import RULES, SOFT_TERMS, STRICT_TERMS, term_hits, url_filter

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://A.NET/x", "http://a.net", "http://net/", "http://xnet/", "http://sub.Example.NET/en/1",
    "http://example.net/fr/", "http://example.com/de/x?free-bets", "http://example.com/DE/x", "http://a.org/fr/casino", "http://a.org/fr",
    "http://casino.com", "http://casinos.com", "http://my_casino_x.com", "http://a.com/free", "http://a.com/free/free", "http://a.com/free-win",
    "http://a.com/FREE?q=Pills", "http://a.com/é-adult", "http://user@host:80/p#f?://y", "a://b://c/d", "line\nbreak://h\nost/p\nath?x",
]


def judged(url):
    """Plain Python, without the automaton."""
    url = url or ""
    match = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    host, path = (lower(match[1]), match[2]) if match else ("", "")
    found = lambda t: len(re.findall(rf"(?<![a-z0-9]){t}(?![a-z0-9])", lower(url)))
    strict, soft = [t for t in STRICT_TERMS if found(t)], [t for t in SOFT_TERMS if found(t)]
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    rule = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    verdict = rule[2] if rule else "block" if strict or len(soft) > 1 else "allow"
    return host, path, rule and rule[0] + rule[1], verdict, len(strict), len(soft), sum(map(found, strict + soft))


def test_against_plain_python(spark):
    schema = "page_id long, url string, host long, rule string, hits string"
    df = spark.createDataFrame([(i, u, 1, "own", "own") for i, u in enumerate(URLS)] + [(0, None, None, None, None)], schema)
    rows = dicts(url_filter(df))
    assert len(rows) == len(URLS) + 1
    for row in rows:
        got = tuple(row[c] for c in ("host", "path", "rule", "verdict", "n_strict", "n_soft", "n_hits"))
        assert got == judged(row["url"]), row
        assert row["hits"] in ("own", None)


def test_empty_table_and_limits(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter(df).collect() == []
    with pytest.raises(ValueError):
        url_filter(df, rules=RULES * 100_000)


def test_overlapping_terms_count_each():
    vocabulary = (("bet", 0.5), ("free", 0.5), ("free-bet", 0.5))
    assert sorted(t for t, _ in term_hits("x/free-bet/", vocabulary)) == ["bet", "free", "free-bet"]
