import random
import re

import pytest
from pyspark.sql import functions as F

from blockspan.llm.decontamination import _masks, benchmark_hits, decontaminate, edit_search, normal, origins

R = random.Random(6)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 8))) for _ in range(400)]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def edited(t, n):
    t = list(t)
    for _ in range(n):
        i = R.randrange(len(t))
        R.choice((lambda: t.insert(i, "Z"), lambda: t.pop(i), lambda: t.__setitem__(i, "Q")))()
    return "".join(t)


def semi(pattern, string):
    row = [0] * (len(string) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(string, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


@pytest.mark.parametrize("seed", range(30))
def test_myers(seed):
    r = random.Random(seed)
    p = "".join(r.choice("abc") for _ in range(r.randint(1, 80)))
    s = "".join(r.choice("abc") for _ in range(r.randint(0, 90)))
    assert edit_search(_masks(p), len(p), s) == semi(p, s)


def test_origins():
    for t in ["", "  a  B\n\tcd ", "x", "İx  y"]:
        n, o = normal(t), origins(t)
        assert len(n) == len(o) and all(c == " " or c == normal(t[int(k)]) or t[int(k)] == "İ" for c, k in zip(n, o, strict=True))


def test_hits_are_brute_force(spark, docs):
    items = [(i, text(R.randint(6, 40))) for i in range(25)] + [(30, "tiny"), (31, ""), (32, None), (33, text(90)), (34, "a word or two"), (3, text(20))]
    items[5] = (5, items[5][1].replace(" ", " \n").upper())
    rows = []
    for i in range(35):
        key, t = R.choice(items[:25] + items[-3:])
        t = R.choice([t, edited(t, R.randint(0, 8)), t.upper(), t.replace(" ", "\n"), "", t[: len(t) // 2]])
        rows.append((i, text(R.randint(0, 60)) + " " + t + " " + text(R.randint(0, 30))))
    rows += [(70, None), (71, ""), (72, " TINY "), (73, "tiny bit"), (None, items[2][1]), (4, rows[4][1])]
    rows += [(80, f"see {items[25][1]}s"), (81, f"(Tiny) {text(9)} {items[-2][1]}"), (82, f"x {edited(items[-2][1], 1)} y"), (83, text(400) + " " + items[3][1])]
    want = []
    for d, t in rows:
        t = normal(t)
        for key, p in items:
            p = normal(p)
            n = -(-len(p) // 300)
            parts = [p, *(p[len(p) * k // n : len(p) * (k + 1) // n] for k in range(n) if n > 1)]
            for part, q in enumerate(parts if p else ()):
                if len(q) < 10:
                    hit = (0 if re.search(rf"(?<![^\W_]){re.escape(q)}(?![^\W_])", t) else 99, 0)
                else:
                    hit = semi(q, t) if t else (99, 0)
                if hit[0] <= len(q) // 10:
                    want.append((d, key, part, hit[0]))
    assert {(81, 30, 0, 0), (73, 30, 0, 0), (72, 30, 0, 0)} <= set(want) and any(k == 34 for _, k, *_ in want)
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (8_000_000, 900):
        got = benchmark_hits(docs(rows).repartition(3), table, block_chars=block, max_chars=300)
        found = got.collect()
        assert sorted(((r.doc_id, r.item_id, r.part, r.distance) for r in found), key=str) == sorted(want, key=str)
        clean = decontaminate(docs(rows), table, block_chars=block, max_chars=300)
        assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d for d, _ in rows if d not in {w[0] for w in want}), key=str)
        assert clean.columns == docs([]).columns
    by, texts = dict((d, t) for d, t in rows if d != 4), {normal(t) for _, t in items}
    for r in found:
        if r.distance == 0 and r.doc_id in by:
            assert any(normal(by[r.doc_id][r.span_start : r.span_end]) in x for x in texts)
    clash = docs(rows).withColumn("item", F.lit("x")).withColumn("id", F.lit(1)).withColumn("part", F.lit(2)).withColumn("distance", F.lit(3))
    assert decontaminate(clash, table).columns == clash.columns and benchmark_hits(clash, table).columns == got.columns


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_hits(docs([(1, "a")]), none).count() == 0 and decontaminate(docs([(1, "a")]), none).count() == 1
    assert benchmark_hits(docs([]), none).count() == 0
