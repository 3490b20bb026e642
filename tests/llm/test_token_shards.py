import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from blockspan.llm.runtime import new_path
from blockspan.llm.token_shards import WaveletMatrix, find_token, read_documents, write_shards


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [1, 2, 50_257, 70_000])
def test_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u4" if top > 1 << 16 else "<u2")
    m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
    assert m.decode().tolist() == ids.tolist()
    for i in range(0, n, 37):
        t = int(ids[i])
        assert m.access(i) == t
        assert m.count(t, 0, i) == (ids[:i] == t).sum() and m.count(t) == (ids == t).sum()
        assert m.select(t, m.rank(t, 0, i)) == i
    assert m.count(99_999) == 0 and m.count(t := 3, n // 3, n // 2) == (ids[n // 3 : n // 2] == t).sum()
    with pytest.raises(IndexError):
        m.select(0, n + 1)


def test_round_trip(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(60)] + [(None, "null"), (77, None), (78, ""), (5, "again"), (90, "long " * 3000)]
    path = new_path(spark, "shards")
    write_shards(docs(rows).repartition(3), path, shard_tokens=200)
    got = read_documents(spark, path, with_ids=True).toPandas().sort_values("start")
    assert got.doc_id.isna().iloc[0] and got.doc_id.dropna().is_monotonic_increasing
    assert got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]]
    want = sorted((-1 if i is None else i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    have = sorted((-1 if i != i else int(i), np.frombuffer(x, "<u4").tolist()) for i, x in zip(got.doc_id, got.tokens, strict=True))
    assert have == want
    assert all(zlib.crc32(x) == c for x, c in zip(got.tokens, got.ids_crc32, strict=True))
    ends = find_token(spark, path, 2).toPandas()
    assert len(ends) == len(rows) and ends.dropna().set_index("doc_id")["at"][90] == 3001


def test_empty(spark, docs):
    path = new_path(spark, "shards")
    write_shards(docs([]), path)
    assert read_documents(spark, path).count() == 0


def test_large_ids_beside_nulls(spark):
    big, path = (1 << 53) + 1, new_path(spark, "shards")
    df = spark.createDataFrame([(big, "one", 1, "a"), (None, "none", 2, "b"), (big + 2, None, 3, "c"), (big + 2, None, 3, "c")], "doc_id long, text string, part int, shard string").coalesce(1)
    write_shards(df, path)
    assert sorted([r.doc_id for r in read_documents(spark, path).collect()], key=str) == sorted([None, big, big + 2, big + 2], key=str)
    found = find_token(spark, path, 2, id_col="key").collect()
    assert sorted([r.key for r in found], key=str) == sorted([None, big, big + 2, big + 2], key=str)
