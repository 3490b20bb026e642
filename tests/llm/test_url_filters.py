import random
import re

import pytest

from blockspan.llm.url_filters import RULES, Automaton, Rule, filter_urls

R = random.Random(4)


def as_regex(glob):
    return "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", glob))


@pytest.mark.parametrize("n", [1, 5, 60])
def test_automaton(n):
    patterns = ["".join(R.choice(["a", "b", "/", "*", "**", "é"]) for _ in range(R.randint(0, 9))).replace("***", "**") for _ in range(n)]
    strings = ["".join(R.choice("ab/é\n") for _ in range(R.randint(0, 12))) for _ in range(300)]
    got = Automaton(patterns).matches([s.encode() for s in strings])
    for j, p in enumerate(patterns):
        want = re.compile(as_regex(p), re.S)
        assert [bool(x) for x in got[:, j]] == [want.fullmatch(s) is not None for s in strings], p


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/x", "http://a.example.net/en", "http://example.net/en/?q#f", "ftp://x.net", "ftp://x.net/",
    "http://net/", "http://notnet/", "http://a.com/x.net/en/", "http://x.Example.com/de/1://y.net/", "http://example.com/DE/1", "http://w.org/fr/", "http://worg/fr/",
    "http://host\nline.net/pa\nth?x", "x://ÄÖ.org/fr/ü", "://net/", "http://" + "a." * 500 + "net/" + "p" * 5000, "http://example.net/en/" * 3,
]


def test_urls(spark):
    more = ["".join(R.choice(["http", "://", "example.", "net", "com", "org", "/", "en/", "de/", "fr/", "?", "#", "X", "."]) for _ in range(R.randint(1, 12))) for _ in range(500)]
    rows = list(enumerate(URLS + more)) + [(None, "http://a.net/"), (3, "http://")]
    df = spark.createDataFrame([(i, u, "clash", "h") for i, u in rows], "page_id long, url string, host string, rule string")
    got = filter_urls(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *brute(u, RULES)) for i, u in rows], key=str)
    assert filter_urls(df.limit(0)).count() == 0


def test_many_rules(spark):
    rules = tuple(Rule("block" if i % 2 else "allow", f"h{i}.com", f"/p{i}/"[: 1 + i % 3]) for i in range(100)) + RULES
    urls = [f"http://{'s.' * (i % 2)}h{i}.com/p{i % 5}/x" for i in range(110)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(map(tuple, filter_urls(df, rules=rules).collect()))
    assert got == [(i, *brute(u, rules)) for i, u in enumerate(urls)]
    assert {r[4] for r in filter_urls(df, rules=()).collect()} == {"allow"}
