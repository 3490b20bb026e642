import random

import corpus_pipeline as p
from blockspan.llm.quality import quality_model, statistics

from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_classes

R = random.Random(21)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 8))) for _ in range(500)]


def sentence(n=12):
    return " ".join(R.choice(WORDS) for _ in range(n)).capitalize() + "."


def prose(n):
    return "\n".join(sentence() for _ in range(n))


def tables(spark, tmp_path):
    benchmark = [(i, sentence(25)) for i in range(5)]
    footer = "This very line stands at the end of many documents of this corpus."
    texts = [prose(R.randint(2, 12)) for _ in range(120)]
    texts += ["\n".join(x.upper() for x in t.split("\n")) + "\n" for t in texts[:10]]  # copies
    texts += [t + " more" for t in texts[20:30] if len(t.split()) > 60]
    texts += [f"{t}\n{footer}" for t in texts[30:45]]
    leaks = range(len(texts), len(texts) + 8)
    texts += [f"{prose(3)}\n{benchmark[i % 5][1].lower()}\n{prose(2)}" for i in range(8)]
    junk = range(len(texts), len(texts) + 60)
    texts += [" | ".join(prose(4).split()) for _ in junk] + ["", None]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if i in junk else 1, 0) for i in range(len(texts) - 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, benchmark, set(leaks), set(junk)


def test_stages(spark, tmp_path):
    rows, benchmark, leaks, junk = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = lambda df: {r.doc_id: r.text for r in df.collect()}

    kept = p.quality(spark, docs, tmp_path)
    model = quality_model(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = {i: t for i, t, *_ in rows if model.scores(statistics(t)[None])[0] >= 0.5}
    assert at(kept) == good and kept.columns == docs.columns
    assert not junk & good.keys() and len(good) >= 0.97 * (len(rows) - len(junk) - 2)

    lines = p.lines(spark, kept, tmp_path)
    want = {i: t for i, t, *_ in brute_lines(list(good.items()))}
    assert at(lines) == want and lines.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = p.near(spark, lines, tmp_path)
    firsts = {i for i, c in brute_classes(list(want.items())) if i == c}
    assert at(near) == {i: want[i] for i in firsts} and len(firsts) < len(want) - 10

    clean = p.benchmarks(spark, near, tmp_path)
    assert at(clean).keys() == firsts - leaks and near.columns == clean.columns == docs.columns

    packed = p.packing(spark, clean, tmp_path).toPandas()
    assert set(packed.doc_id) == firsts - leaks and packed.length.groupby(packed.sequence_id).sum().max() <= 1024
    whole = p.run(spark, str(tmp_path)).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert whole[key].sort_values(key).values.tolist() == packed[key].sort_values(key).values.tolist()


def test_hard_rows(spark, tmp_path):
    tables(spark, tmp_path)
    rows = [(None, prose(6)), (1, None), (2, ""), (3, t := prose(8)), (3, t), (4, t), (5, "long line of words " * 20_000), (None, t)]
    df = spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines int")
    for _, stage in p.STAGES[1:4]:
        out = stage(spark, df, tmp_path)
        assert out.columns == df.columns and stage(spark, df.limit(0), tmp_path).count() == 0
        df = out
    assert sorted((r.doc_id for r in df.collect()), key=str) == sorted([None, None, 1, 2, 3, 5], key=str)
    assert p.quality(spark, df, tmp_path).columns == df.columns


def test_columns_of_the_user_come_back(spark, tmp_path):
    tables(spark, tmp_path)
    names = ["score", "predicted", "n_lines", "n_dropped", "first", "print", "label", "h", "id", "node", "key", "odd name", "column 2"]
    rows = [(i, prose(6), *(f"{c} {i}" for c in names)) for i in range(6)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for name, stage in p.STAGES[:4]:
        out = stage(spark, df, tmp_path)
        assert out.columns == df.columns
        got = [tuple(r) for r in out.collect()]
        assert name == "quality" or len(got) == 6
        assert all(r[2:] == rows[r[0]][2:] for r in got), name
