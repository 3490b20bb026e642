import hashlib
import random

import pytest

from blockspan.llm.fingerprints import BOUND, bucket_counts, difference, digest, fingerprint, fingerprint_likeness, fingerprint_neighbours, likeness

R = random.Random(2)


def text(n, r=R):
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(200)]
    return " ".join(r.choice(words) for _ in range(n))


def brute(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = digest(t), digest(e), digest(nxt)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def test_digest():
    t = text(500)
    assert digest(t) == digest(t) and len(digest(t)) == len(digest("")) == len(digest("x" * 100_000)) == 134
    near, far = digest(t.replace("a ", "b ", 3)), digest(text(500))
    assert difference(digest(t), digest(t)) == 0 < difference(digest(t), near) < difference(digest(t), far) <= BOUND
    assert digest("ab") != digest("abcd") and digest(None) == digest("")
    assert bucket_counts(b"abcdefgh").sum() == 24


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_neighbours(docs, ranges):
    rows = [(i * 3, text(R.randint(0, 60)) + "é日" * (i % 3)) for i in range(70)] + [(7, None), (8, ""), (None, "no id"), (30, "twice"), (31, "x" * 50_000)]
    got = fingerprint_neighbours(docs(rows).repartition(3), ranges=ranges)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_alone_and_empty(docs):
    assert fingerprint_neighbours(docs([])).count() == 0
    assert tuple(fingerprint_neighbours(docs([(5, "all alone here")])).first())[:3] == brute([(5, "all alone here")])[0][:3]


def test_columns(spark, docs):
    df = docs([(1, "some text of a kind"), (2, None)]).select("doc_id", fingerprint("text").alias("f"))
    assert df.select(fingerprint_likeness("f", "f").alias("n")).distinct().collect() == [(1.0,)]
