import random
import re
import time
from functools import lru_cache

import numpy as np
import pytest

from blockspan.llm.components import components
from blockspan.llm.near_dedup import alike, links_within_buckets, near_duplicates
from blockspan.llm.order_minhash import families, labelled, occurrences, sketches
from blockspan.llm.runtime import settle
from blockspan.llm.sequences import alignment_similarity, common_subsequence, shingles, words

R = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(3000)]


def text(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(t, edits, r=R):
    w = t.split()
    for _ in range(edits):
        i = r.randrange(len(w))
        r.choice((lambda: w.insert(i, "new"), lambda: w.pop(i), lambda: w.__setitem__(i, "other")))()
    return " ".join(w)


def corpus():
    rows = []
    for n, edits in ((6, 0), (30, 1), (60, 1), (150, 3), (400, 8), (2000, 30)):
        for _ in range(3):
            t = text(n)
            rows += [t, t.upper() + " !!", *(edited(t, edits if n > 6 else 0) for _ in range(4))]
    base = text(300)  # a chain: each like its neighbours, the ends unlike
    for _ in range(8):
        rows.append(base)
        base = edited(base, 4)
    hot = text(50)
    rows += [hot + " " + text(40) for _ in range(40)]  # a passage in common makes no copies
    line = "the same line again and again "
    rows += [line * 60 + text(25) for _ in range(15)]
    rows += [line * 60 + t + " " + x for t in [text(150)] for x in ("", "end", "an end")]
    forty = text(40)
    rows += [forty, " ".join([forty] * 7), " ".join([forty] * 8), " ".join([forty] * 7 + ["more"])]
    long = text(6_000)
    rows += [long, edited(long, 40), long + " " + text(3_000)]
    rows += ["", None, "!!! ...", "one", "One.", "short text here", *[text(80)] * 30]
    return list(enumerate(rows)) + [(None, rows[0]), (None, text(20)), (3, rows[3])]


def plain_words(t):
    return tuple(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()))


@lru_cache(None)
def plain_shingles(w, k):
    s = [w[i : i + k] for i in range(max(1, len(w) - k + 1))]
    return s, set(s)


def similar(a, b, k=5, threshold=0.8):
    """By the definition, with nothing of the operator: sets of shingles, then a table."""
    (a, x), (b, y) = plain_shingles(a, k), plain_shingles(b, k)
    if min(len(x), len(y)) < threshold * max(len(x), len(y)) or len(x & y) < threshold * len(x | y) or min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    m = longest(a, b)
    return m >= threshold * (len(a) + len(b) - m)


def longest(a, b):
    code = {}
    a, b = (np.array([code.setdefault(s, len(code)) for s in x], np.int64) for x in (a, b))
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return int(row[-1])


def brute(rows, k=5, threshold=0.8):
    found = [plain_words(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if found[i] and found[j] and top(i) != top(j) and (found[i] == found[j] or similar(found[i], found[j], k, threshold)):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted([(d, d if not found[i] else least.get(top(i))) for i, (d, _) in enumerate(rows)], key=str)


def test_words():
    assert words("Ab c-d  É").tolist() == words(" ab C D é!").tolist() and len(words("ab c-d é")) == 4
    assert len(words(None)) == len(words(" .")) == 0 and words("a b").tolist() != words("b a").tolist()
    long = words("x y " * 100_000)
    assert len(set(long.tolist())) == 2


@pytest.mark.parametrize("seed", range(40))
def test_alignment_is_the_longest_common_subsequence(seed):
    r = np.random.default_rng(seed)
    a, b = (r.integers(0, 6, r.integers(0, 25)).astype(np.uint64) for _ in "ab")
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    assert common_subsequence(a, b, 100) == table[-1, -1]
    assert common_subsequence(a, b, 2) <= table[-1, -1]
    exact = table[-1, -1] / max(1, len(a) + len(b) - table[-1, -1])
    if exact >= 0.5:
        assert alignment_similarity(a, b, 0.5) == exact


def test_labels():
    s = np.array([5, 5, 7, 5, 5, 5, 5, 5, 5, 7], np.uint64)
    assert occurrences(s).tolist() == [0, 1, 0, 2, 3, 4, 5, 6, 7, 1]
    assert len(set(labelled(s).tolist())) == len(s) and labelled(s)[[0, 2]].tolist() == [5, 7]
    assert not len(sketches(s[:0], 0.8)) and set(sketches(s, 0.8)) <= set(sketches(s.copy(), 0.8))


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.8, 0.9, 0.95])
def test_sketches_reach_the_threshold(threshold):
    r = np.random.default_rng(3)
    missed = tried = 0
    for n in (1, 2, 6, 11, 12, 13, 25, 31, 39, 40, 41, 60, 300):
        for _ in range(40):
            a = r.integers(0, 1 << 60, n).astype(np.uint64)
            m = -(-int(round(threshold * n * 1e6)) // 1_000_000)  # the shorter is a part of the longer
            b = np.delete(a, r.choice(n, n - m, replace=False)) if n > m else a
            if len(b) >= threshold * n:
                tried += 1
                missed += not set(sketches(a, threshold)) & set(sketches(b, threshold))
    assert tried > 400 and missed <= 0.02 * tried, (missed, tried)
    assert all(b[0] <= max(1, a[1] * threshold) for a, b in zip(families(threshold), families(threshold)[1:], strict=False))


@pytest.mark.parametrize("threshold", [0.5])
def test_other_thresholds(docs, threshold):
    r = random.Random(9)
    rows = [x for n in (20, 35, 64, 200) for t in [text(n, r)] for x in (t, edited(t, 1, r), edited(t, n // 16, r), t + " " + text(n // 2, r))]
    got = near_duplicates(docs(list(enumerate(rows))), threshold=threshold).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(list(enumerate(rows)), threshold=threshold)


def test_classes_are_brute_force(docs):
    rows = corpus()
    got = near_duplicates(docs(rows).repartition(4)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


@pytest.mark.parametrize("small", [5])
def test_one_bucket_holds_all_links(spark, small):
    r = random.Random(5)
    chain = [text(150, r)]
    for _ in range(59):  # copies that drift: the leader is unlike most of them
        chain.append(edited(chain[-1], 3, r))
    chain += [x for _ in range(15) for t in [text(60, r)] for x in (t, edited(t, 1, r))]
    found = [words(t) for t in chain]
    plain = [plain_words(t) for t in chain]
    pairs = [(i, j) for j in range(len(chain)) for i in range(j) if similar(plain[i], plain[j])]
    assert any(not ({(0, i), (0, j)} & set(pairs)) for i, j in pairs)
    ids = r.sample(range(1000), len(chain))
    nodes = spark.createDataFrame([(i, [7]) for i in ids], "node long, keys array<long>")
    sequences = spark.createDataFrame([(i, w.tobytes()) for i, w in zip(ids, found, strict=True)], "node long, words binary")
    got = [tuple(x) for df in links_within_buckets(nodes, sequences, 5, 0.8, small) for x in df.collect()]
    assert {tuple(sorted(x)) for x in got} <= {tuple(sorted((ids[i], ids[j]))) for i, j in pairs}
    want = components(spark.createDataFrame([(ids[i], ids[j]) for i, j in pairs], "a long, b long")).collect()
    assert sorted(components(spark.createDataFrame(got, "a long, b long")).collect()) == sorted(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (200, 200)] + [(500, i) for i in range(501, 540)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == 100 and got[539] == 500 and 200 not in got


def test_alike():
    a = shingles(words(text(40, random.Random(2))), 5)
    assert alike(a, a, 1.0) and not alike(a, np.tile(a, 7), 0.8) and not alike(a, a[::-1], 0.8)


def test_clashing_columns(spark):
    t = text(60)
    kinds = "doc_id long, text string, node string, keys int, n int, class_id string, label int, id string, key int"
    df = spark.createDataFrame([(i, x, "a", 1, 2, "b", 3, "c", 4) for i, x in ((2, t), (1, t + " end"), (None, t), (2, t))], kinds)
    assert sorted([tuple(r) for r in near_duplicates(df).collect()], key=str) == [(1, 1), (2, 1), (2, 1), (None, 1)]


def test_empty(docs):
    assert near_duplicates(docs([])).count() == 0


def test_rounds_leave_no_shuffle_files(spark):
    """Disk holds a few rounds, however many there were."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {x.rsplit("/", 1)[-1] for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before, rows = files(), spark.range(1000).withColumnRenamed("id", "n")
    for k in range(8):
        rows = settle(rows.repartition(5 + k, "n"))
    until = time.time() + 30  # Spark cleans in a thread of its own
    while (left := {x.split("_")[1] for x in files() - before}) and len(left) > 3 and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 3 and rows.count() == 1000
