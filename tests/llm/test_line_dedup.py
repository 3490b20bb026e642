import random
from collections import Counter

import numpy as np
import pytest

from blockspan.llm.line_dedup import PerfectHash, line_dedup


def brute(rows, min_chars=40, min_docs=5):
    def k(x):
        return x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()

    holders, counts = {}, Counter()
    for i, t in rows:
        for x in {k(x) for x in (t or "").split("\n")}:
            if len(x) >= min_chars:
                counts[x] += 1
                holders[x] = max(holders.get(x, -(1 << 63)), -(1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = -(1 << 63) if i is None else i
        kept = [x for x in lines if counts[k(x)] < min_docs or holders[k(x)] == own]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def rows():
    r = random.Random(3)
    common = [f"Common LINE number {i} that many documents repeat ÄÖ" for i in range(40)] + ["x" * 39, "y" * 40, "  " + "z" * 39]
    out = []
    for i in range(80):
        lines = [r.choice(common) if r.random() < 0.6 else f"own {r.random()} line of this document, rather long" for _ in range(r.randint(0, 12))]
        lines = [x.upper() if r.random() < 0.2 and x.isascii() else f" \t{x}\r" if r.random() < 0.2 else x for x in lines]
        out.append((i, "\n".join(lines)))
    hot = "the very same line stands in every one of these documents"
    return out + [(100 + i, hot) for i in range(50)] + [(None, hot), (149, hot + "\n" + hot), (3, None), (4, ""), (5, "\n\n")]


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 30_000).astype(np.uint64)
    keys = np.unique(keys)
    h = PerfectHash(keys)
    assert sorted(h(keys).tolist()) == list(range(len(keys)))
    h = PerfectHash(keys, max_levels=2)
    assert sorted(h(keys).tolist()) == list(range(len(keys))) and len(h.rest)
    assert PerfectHash(keys[:0])(keys[:3]).tolist() == [-1] * 3


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_both_ways_are_brute_force(docs, bound, monkeypatch):
    monkeypatch.setattr("blockspan.llm.line_dedup.SHARD_KEYS", 7)
    data = rows()
    df = docs(data).repartition(5)
    got = line_dedup(df, broadcast_bytes=bound, rows_per_salt=20)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    have = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)
    assert have == sorted(brute(data), key=str)


@pytest.mark.parametrize("bound", [1 << 20, -1])
def test_empty_and_other_columns(spark, docs, bound):
    assert line_dedup(docs([]), broadcast_bytes=bound).count() == 0
    assert line_dedup(docs([(1, "a"), (2, None)]), broadcast_bytes=bound).count() == 2
    df = spark.createDataFrame([(1, "a", [{"b": 1}], 5, None), (1, None, None, 6, 2.5)], "doc_id int, text string, `odd name` array<map<string,int>>, n_lines int, id double")
    got = line_dedup(df, broadcast_bytes=bound)
    assert got.columns == ["doc_id", "text", "odd name", "id", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "", None, 2.5, 1, 0), (1, "a", [{"b": 1}], None, 1, 0)]
