import json
import random
import time

import pytest
from pyspark.sql import functions as F

from blockspan.operators import endpoints, manifest, relations
from blockspan.operators.predicates import LogSelection, TransactionSelection
from blockspan.plans import paging
from blockspan.plans.compile import matched, response_rows
from blockspan.plans.paging import Admission, Limits, TooManyQueries, answer, page_by_size, to_json
from blockspan.plans.query import Query, QueryError, make_query, parse_query

from .fixtures import brute, chain, h, tables


def some_query(r):
    pick = lambda f, n: tuple(f(x) for x in r.sample(range(4), r.randint(0, n)))
    logs = [LogSelection(pick(lambda x: h(x, 20), 2), tuple(pick(h, 2) for _ in range(r.randint(0, 4)))) for _ in range(r.randint(0, 2))]
    a = lambda: pick(lambda x: h(x, 20), 2)
    txs = [TransactionSelection(a(), a(), r.choice([(), (b"abcd",), (b"wxyz", b"none")]), r.choice([None, 0, 1])) for _ in range(r.randint(0 if logs else 1, 2))]
    first = r.randint(0, 4)
    return make_query(first, r.choice([None, first + r.randint(1, 9)]), logs, txs, r.random() < 0.3)


@pytest.mark.parametrize("semantics", ["documented", "literal"])
def test_matches_are_brute_force(spark, semantics):
    data, r = chain(), random.Random(5)
    t = tables(spark, data)
    for _ in range(8):
        q = some_query(r)
        m = matched(t, q, semantics)
        got = (
            sorted(x.number for x in m.blocks.collect()),
            sorted((x.block_number, x.transaction_index) for x in m.transactions.collect()),
            sorted((x.block_number, x.log_index) for x in m.logs.collect()),
        )
        assert got == brute(data, q, semantics == "literal"), q


BODY = {
    "fromBlock": 2, "toBlock": 6, "unknown": 1,
    "logs": [{"address": None, "topics": [["0x" + h(1).hex(), "0x" + h(2).hex().upper()]], "fieldSelection": {"log": {"address": True, "topics": True, "index": True, "transaction": True}, "block": {"number": True, "nonce": True}}}],
    "transactions": [{"address": ["0x" + h(1, 20).hex()], "status": 1, "fieldSelection": {"transaction": {"from": True, "nonce": True, "index": True, "value": True, "status": True, "hash": False}}}],
}


def test_parse():
    q = parse_query(json.dumps(BODY))
    assert (q.first, q.end, q.include_all_blocks) == (2, 7, False) and q.logs[0].topics == ((h(1), h(2)),) and q.transactions[0].dest == (h(1, 20),)
    assert q.fields["log"] == {"address", "topics", "index"} and q.fields["transaction"] == {"from", "nonce", "index", "value", "status"}


@pytest.mark.parametrize(
    "change",
    [{"fromBlock": 7}, {"fromBlock": -1}, {"fromBlock": "1"}, {"fromBlock": 2**32}, {"logs": [], "transactions": []}, {"logs": [{"topics": [["0x00"]], "fieldSelection": {}}]}, {"logs": [{"fieldSelection": {}}]}, {"logs": [{"topics": [[]] * 5, "fieldSelection": {}}]}, {"logs": [{"topics": []}]}, {"transactions": [{"to": [], "address": [], "fieldSelection": {}}]}, {"includeAllBlocks": 1}],
)
def test_bad_queries(change):
    with pytest.raises(QueryError):
        parse_query(BODY | change)


def test_not_json():
    for text in ("{", "[]", "{}"):
        with pytest.raises(QueryError):
            parse_query(text)


def test_response_shape(spark):
    data = chain()
    t, q = tables(spark, data), parse_query(BODY)
    rows = {r.number: json.loads(r.entry) for r in response_rows(t, q).collect()}
    mb, mt, ml = brute(data, q)
    assert sorted(rows) == mb
    for n, e in rows.items():
        assert e["block"] == {"number": n} | ({"nonce": str(2**64 - 1)} if n == 3 else {})
        assert [x["index"] for x in e["transactions"]] == [i for b, i in mt if b == n] and [x["index"] for x in e["logs"]] == [i for b, i in ml if b == n]
        assert all(x["value"] == "0x" + "ff" * 32 and x["nonce"] == str(x["index"]) and "hash" not in x for x in e["transactions"])
        assert all(t.startswith("0x") and len(t) == 66 for x in e["logs"] for t in x["topics"])
    none = Query(2, 7, q.logs, q.transactions, False, {"log": frozenset(("address",))})
    e = json.loads(response_rows(t, none).first().entry)
    assert "block" not in e and e["transactions"] == [] and all(set(x) == {"address"} for x in e["logs"])


def test_pages_make_up_the_answer(spark):
    t, q = tables(spark, chain()), parse_query(BODY | {"fromBlock": 0, "toBlock": 100})
    whole = answer(t, q, 12, Limits())
    assert whole["nextBlock"] == 12 and whole["archiveHeight"] == 11 and len(whole["data"]) == 1
    entries, at, pages = [], 0, 0
    while at < 12:
        page = answer(t, Query(at, q.end, q.logs, q.transactions, False, q.fields), 12, Limits(max_bytes=1500, batch_blocks=5))
        assert page["nextBlock"] > at
        entries += [e for b in page["data"] for e in b]
        at, pages = page["nextBlock"], pages + 1
    assert entries == whole["data"][0] and pages > 2
    assert json.loads(to_json(whole))["data"][0] == [json.loads(e) for e in entries]
    assert answer(t, Query(12, None, q.logs), 12)["data"] == [] and answer(t, Query(12, None, q.logs), 12)["nextBlock"] == 12
    assert answer(t, Query(3, None, q.logs), 0)["archiveHeight"] is None
    ticks = iter(range(0, 10_000, 40))
    late = answer(t, q, 12, Limits(max_ms=60_000, batch_blocks=3), clock=lambda: next(ticks))
    assert late["nextBlock"] == 6  # a batch that was read is kept, and the next page goes on behind it


def test_admission():
    a = Admission(1)
    with a(), pytest.raises(TooManyQueries), a():
        pass
    with a():
        pass


def folders(spark, *names):
    return manifest.parse_folders(spark.createDataFrame([(n,) for n in names], "name string"))


def test_manifest(spark):
    f = folders(spark, "blk000000000-000000010", "blk000000010-000000030", "blk000000030-000000040temp", "blk000000040-000000050", "other", "blk1-2")
    assert f.count() == 4
    start = lambda df: manifest.resume_block(df).first()[0]
    assert start(f) == 30 and start(f.where("`from` < 30")) == 30 and start(f.limit(0)) == 0
    with pytest.raises(Exception, match="first folder"):
        start(f.where("`from` > 5"))
    run = lambda n: [tuple(r) for r in manifest.contiguous_run(f, n).collect()]
    assert run(0) == [(0, 10), (10, 30)] and run(10) == [(10, 30)] and run(5) == [] and run(40) == [(40, 50)]
    assert [tuple(r) for r in manifest.gaps(f).collect()] == [(30, 40)] and tuple(manifest.hull(f).first()) == (0, 50)
    clip = manifest.overlapping(f, 9, 11).select("from", "clip_from", "clip_to").collect()
    assert sorted(map(tuple, clip)) == [(0, 9, 10), (10, 10, 11)]
    assert f.select(manifest.folder_name(F.col("from"), F.col("to"))).first()[0] == "blk000000000-000000010"


def test_heights(spark):
    f = folders(spark, "blk000000000-000000010")
    hot = spark.createDataFrame([(8,), (14,)], "number long")
    assert tuple(manifest.heights(f, hot).first()) == (10, 8, 15, 15)
    assert tuple(manifest.heights(f, hot.limit(0)).first()) == (10, None, None, 10)
    assert tuple(manifest.heights(f, hot.where("number > 10")).first()) == (10, 14, 15, 10)
    assert tuple(manifest.heights(f.limit(0), hot.limit(0)).first()) == (0, None, None, 0)


def test_relations(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, None, 1)], "k long, v string, seq long")
    assert sorted(map(tuple, relations.last_wins(rows, ["k"], "seq").collect())) == [(1, "b", 3), (2, None, 1)]
    sized = spark.createDataFrame([(i, 10) for i in range(50)], "n long, size long")
    for bucket in (1, 7, 1000):
        assert sorted(r.n for r in page_by_size(sized, "n", "size", 95, bucket).collect()) == list(range(10))
    tx = spark.createDataFrame([(1, 0, None), (1, 1, None)], "block_number long, transaction_index long, status long")
    receipts = spark.createDataFrame([(1, 0, 1)], tx.schema)
    with pytest.raises(Exception, match="no receipt"):
        relations.with_status(tx, receipts).collect()
    assert [r.status for r in relations.with_status(tx.limit(1), receipts).collect()] == [1]


def test_endpoints(spark):
    e = spark.createDataFrame([("a", 100), ("b", 97), ("c", 50), ("d", None)], "endpoint string, height long")
    assert sorted(map(tuple, endpoints.healthy(e).collect())) == [("a", 100, 97), ("b", 97, 97)] and endpoints.healthy(e.limit(0)).count() == 0
    t = spark.createDataFrame([(100, 50), (3, 0)], "n_blocks long, millis long")
    assert [r.blocks_per_second for r in endpoints.throughput(t).collect()] == [2000.0, None]


def test_a_late_batch_is_cancelled(spark, monkeypatch):
    t = tables(spark, chain())
    q = parse_query('{"fromBlock": 0, "includeAllBlocks": true, "logs": [{"address": [], "topics": [], "fieldSelection": {"block": {"number": true}}}]}')
    whole = answer(t, q, 12)
    calls, plain = [], paging.response_rows

    def slow(tables, part, semantics):
        calls.append((part.first, part.end))
        rows = plain(tables, part, semantics)
        if part.end - part.first < 10:
            return rows
        wait = F.udf(lambda x: time.sleep(30) or x)
        return rows.withColumn("entry", wait("entry"))

    monkeypatch.setattr(paging, "response_rows", slow)
    began = time.monotonic()
    page = answer(t, q, 12, Limits(max_ms=1500, batch_blocks=12))
    assert time.monotonic() - began < 25 and calls[:2] == [(0, 12), (0, 1)] and page["nextBlock"] == 1
    assert page["data"][0] == whole["data"][0][:1]
