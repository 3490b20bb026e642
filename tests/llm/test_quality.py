import random
import zlib

import numpy as np

from blockspan.llm.quality import N_STATISTICS, fit, held_out, isotonic, quality_model, score, statistics

R = random.Random(9)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 8))) for _ in range(400)]


def good():
    return "\n".join(" ".join(R.choice(WORDS) for _ in range(R.randint(5, 15))).capitalize() + "." for _ in range(R.randint(1, 20)))


def bad():
    kind = R.randrange(3)
    words = good().split()
    return " | ".join(words) if kind == 0 else " ".join(w + R.choice(["%%", "##", "$$"]) for w in words) if kind == 1 else " ".join(w.upper() + "!!" for w in words)


def test_statistics():
    assert len(statistics("")) == N_STATISTICS == len(statistics(None)) and np.isfinite(statistics("")).all()
    assert np.isfinite(statistics("x" * 2_000_000)).all() and np.isfinite(statistics("\x00é日\n\n")).all()
    assert (statistics("A b.") != statistics("a b")).any()


def test_isotonic():
    x, y = isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5]), np.ones(6))
    assert (np.diff(y) > 0).all() and np.isclose(y, [0, 0.5, 5 / 6]).all() and (np.diff(x) > 0).all()


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = sum(y)
    return (rank[np.array(y) == 1].sum() - n * (n + 1) / 2) / n / (len(y) - n)


def test_held_out_accuracy(spark, docs):
    labels = {i: int(R.random() < 0.8) for i in range(1500)}
    rows = [(i, good() if y else bad()) for i, y in labels.items()] + [(2000, None), (2001, ""), (None, "no id"), (2002, "é " * 100_000)]
    df = docs(rows).repartition(5).withColumn("score", held_out())
    marks = spark.createDataFrame([(i, y, 0) for i, y in labels.items()] + [(None, 1, 0), (2000, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = score(df, quality_model(df, marks)).toPandas()
    assert len(got) == len(rows) and list(got.columns) == [*docs([]).columns, "score", "predicted"]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    test = got[[d == d and d in labels and zlib.crc32(str(int(d)).encode()) % 3 == 1 for d in got.doc_id]]
    y = [labels[d] for d in test.doc_id]
    assert len(y) > 300 and auc(y, test.score.to_numpy()) > 0.99 and (np.array(y) == test.predicted).mean() > 0.97


def test_nothing_to_learn(spark, docs):
    none = spark.createDataFrame([], "text string, label int")
    one = spark.createDataFrame([("a", 1), ("b", 1), (None, None)], none.schema)
    assert {r.predicted for r in score(docs([(1, "x"), (2, None)]), fit(one)).collect()} == {1}
    assert score(docs([(1, "x")]), fit(none)).count() == 1 and score(docs([]), fit(one)).count() == 0


def test_sample_is_bounded(spark):
    rows = spark.createDataFrame([(f"{good() if i % 4 else bad()}", int(i % 4 > 0)) for i in range(400)], "text string, label int")
    a, b = fit(rows, max_rows=200), fit(rows.repartition(7), max_rows=200)
    assert np.allclose(a.mean, b.mean) and a.knots[1].max() > 0.5


def test_partition_sums_are_one_solve(spark):
    """Mean, scale and weights of the fit against one least-squares solve over all rows."""
    rows = [(good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(300)]
    rows += rows[:20]  # repeated rows count each
    df = spark.createDataFrame(rows, "text string, label int").repartition(5)
    model = fit(df, features=40)
    h = {r.text: r.fold for r in df.selectExpr("text", "pmod(shiftright(xxhash64(text, 7), 24), 4) as fold").collect()}
    stats, label = np.array([statistics(t) for t, _ in rows]), np.array([y for _, y in rows], float)
    fold = np.array([h[t] for t, _ in rows])
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, np.where(stats.std(0) > 1e-9, stats.std(0), 1), rtol=1e-4, atol=1e-6)
    z, y, rate = model.features(stats[fold != 0]), label[fold != 0], label.mean()
    w = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate))
    root = np.sqrt(w)[:, None]
    damp = np.sqrt(1e-5 * w.sum()) * np.eye(z.shape[1])
    weights = np.linalg.lstsq(np.r_[z * root, damp], np.r_[y * root[:, 0], np.zeros(len(damp))], rcond=None)[0]
    assert np.allclose(z @ model.ridge, z @ weights, atol=1e-3)
