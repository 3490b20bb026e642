import json
import threading
import urllib.error
import urllib.request
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from blockspan.plans.paging import Limits
from blockspan.schema import BLOCKS, LOGS, TRANSACTIONS
from blockspan.server import Forwarder, Service, archive_routes, forwarder_routes, serve
from blockspan.sources import legacy, rpc
from blockspan.sources.storage import Archive, WriteOptions
from blockspan.operators.manifest import FILES
from blockspan.operators.predicates import LogSelection, TransactionSelection, any_log, any_transaction
from blockspan.streaming.ingest import decode, finalise_ready, flush, import_older, ingest, start_block, write_hot
from blockspan.streaming.metrics import IngestListener, Metrics

from . import node as fake
from .fixtures import chain, tables

NODE = rpc.Node(("http://a", "http://b", "http://far", "http://dead"), fake.transport, rpc.Retry(2, 0), max_behind=5, best_block_offset=2, max_batch=7)


def test_requests():
    assert rpc.block_by_number(255)["params"] == ["0xff", True] and rpc.logs_in(1, 16)["params"] == [{"fromBlock": "0x1", "toBlock": "0x10"}]
    assert rpc.block_receipts(0)["params"] == ["0x0"] and rpc.best_block(4)["id"] == 4
    for bad in (None, [], {"result": None}, {"error": {"code": 1}, "result": 1}):
        with pytest.raises(rpc.RpcError):
            rpc.result_of(bad)
    with pytest.raises(rpc.RpcError):
        rpc.results_of([{"id": 1, "result": 2}], [{"id": 0}])


def test_node():
    assert NODE.healthy() == (["http://a", "http://b"], fake.TIP - 4)
    found = list(NODE.blocks(3, 9))
    assert [n for n, *_ in found] == list(range(3, 9)) and json.loads(found[2][1])["number"] == "0x5" and len(json.loads(found[0][2])) == 3
    with pytest.raises(rpc.RpcError):
        rpc.Node(("http://dead",), fake.transport, rpc.Retry(2, 0)).healthy()


def test_retry_and_rate():
    calls = []

    def fails_twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return 5

    assert rpc.Retry(None, 0)(fails_twice) == 5 and len(calls) == 3
    with pytest.raises(rpc.RpcError, match="2 tries"):
        rpc.Retry(2, 0)(lambda: 1 / 0)
    now = [0.0]
    limit = rpc.RateLimit(3, lambda: now[0])
    limit.count("a", 2), limit.count("b")
    with pytest.raises(rpc.RpcError):
        limit.count("a")
    now[0] = 1.0
    limit.count("a", 3)


def test_decode(spark):
    raw = spark.createDataFrame(list(NODE.blocks(0, 8)), rpc.SCHEMA)
    t = decode(raw)
    assert [t.blocks.schema.names, t.transactions.schema.names, t.logs.schema.names] == [BLOCKS.names, TRANSACTIONS.names, LOGS.names]
    assert {f.name: f.dataType for f in t.transactions.schema} == {f.name: f.dataType for f in TRANSACTIONS}
    txs = t.transactions.collect()
    assert len(txs) == 12 and all(x.status == 1 for x in txs) and sum(x.dest is None for x in txs) == 2
    assert {x.sighash and bytes(x.sighash).hex() for x in txs} == {None, "a9059cbb"} and bytes(txs[0].value) == b"\x0f" + b"\xff" * 31
    assert t.blocks.where("number = 3").first().nonce == Decimal(2**64 - 1)
    assert sorted((x.topic0 is None, x.topic1 is None) for x in t.logs.collect()).count((False, True)) == 12
    bad = raw.withColumn("block", F.regexp_replace("block", '"0x5208"', '"5208"'))
    with pytest.raises(Exception, match="bad"):
        decode(bad).transactions.collect()


def test_batch_source(spark):
    spark.dataSource.register(rpc.source_for(NODE))
    df = spark.read.format("blockrpc").option("startingBlock", 2).option("endingBlock", 9).option("blocksPerBatch", 3).load()
    assert df.rdd.getNumPartitions() == 3 and sorted(r.number for r in df.collect()) == list(range(2, 9))


def test_ingest_to_hot_and_cold(spark, tmp_path):
    spark.dataSource.register(rpc.source_for(NODE))
    archive = Archive(spark, f"file://{tmp_path}/archive", WriteOptions(folder_blocks=6))
    assert archive.height() == 0 and start_block(archive) == 0 and start_block(archive, 100, 30) == 70
    raw = spark.readStream.format("blockrpc").option("startingBlock", 0).option("blocksPerBatch", 14).load()
    q = ingest(spark, raw, archive, f"{tmp_path}/checkpoint", metrics=(metrics := Metrics()), tip=lambda: fake.TIP, processingTime="0 seconds")
    try:
        q.processAllAvailable()
        assert q.exception() is None
    finally:
        q.stop()
    height = fake.TIP - 3
    h = archive.heights()
    assert f"write_height {height - 1}" in metrics.encode() and f"chain_height {fake.TIP}" in metrics.encode()
    assert h["height"] == height and h["parquet_height"] == 18
    t = archive.tables()
    numbers = sorted(r.number for r in t.blocks.select("number").collect())
    assert numbers == list(range(height)) and t.transactions.count() == sum(n % 4 for n in range(height)) and t.logs.count() == 2 * t.transactions.count()
    write_hot(archive, decode(spark.createDataFrame(list(NODE.blocks(19, 21)), rpc.SCHEMA)))  # again
    assert archive.tables().blocks.count() == height and finalise_ready(archive) == []
    assert archive.tables(7, 13).blocks.where("number < 13 and number >= 7").count() == 6
    assert flush(archive) == (18, height) and flush(archive) is None
    assert archive.heights()["parquet_height"] == height == archive.tables().blocks.count() and start_block(archive) == height

    service = Service(archive, Limits(batch_blocks=4))
    server = serve(archive_routes(service), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda path, data=None: json.loads(urllib.request.urlopen(base + path, data).read())
    try:
        assert get("/height") == {"height": height - 1}
        fields = {"block": {"number": True}, "log": {"index": True, "topics": True}, "transaction": {"index": True, "to": True}}
        page = get("/query", json.dumps({"fromBlock": 5, "toBlock": 11, "logs": [{"address": [fake.x(1, 20)], "topics": [], "fieldSelection": fields}]}).encode())
        entries = [e for b in page["data"] for e in b]
        assert [e["block"]["number"] for e in entries] == [5, 6, 7, 9, 10, 11] and page["nextBlock"] == 12
        assert all(len(e["logs"]) == len(e["transactions"]) == e["block"]["number"] % 4 for e in entries)
        for path, data, code in (("/query", b"{", 500), ("/none", None, 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path, data)
            assert e.value.code == code
    finally:
        server.shutdown()


def test_follow_deals_ranges(spark):
    follow = rpc._Follow(NODE, 2, None, 16)
    assert follow.initialOffset() == {"block": 2} and follow.latestOffset() == {"block": 18}
    parts = follow.partitions({"block": 2}, {"block": 18})
    assert [(p.first, p.end) for p in parts] == [(a, a + 2) for a in range(2, 18, 2)] and [r[0] for r in follow.read(parts[1])] == [4, 5]
    assert follow.latestOffset() == {"block": fake.TIP - 3} == follow.latestOffset()
    again = rpc._Follow(NODE, 2, 20, 16)  # after a restart
    assert again.latestOffset() == {"block": 20} and again.partitions({"block": 20}, {"block": 20}) == []


def test_folders_end_where_rows_are_many(spark, tmp_path):
    t = tables(spark, chain())
    archive = Archive(spark, f"file://{tmp_path}/rolled", WriteOptions(folder_blocks=8, folder_rows=20))
    write_hot(archive, t)
    done = finalise_ready(archive)
    assert len(done) > 1 and done[0][0] == 0 and all(a[1] == b[0] for a, b in zip(done, done[1:], strict=False))
    sizes = {r.block_number: r["count"] for r in t.transactions.groupBy("block_number").count().collect()}
    for first, end in done:
        assert end - first == 8 or sum(sizes.get(n, 0) for n in range(first, end - 1)) < 20
    assert archive.tables().transactions.count() == t.transactions.count()


def test_folders_prune_and_carry_blooms(spark, tmp_path):
    archive = Archive(spark, str(tmp_path))
    t = tables(spark, chain())
    for a, b in ((0, 4), (4, 12)):
        archive.write_folder(a, b, t.blocks, t.transactions, t.logs)
    assert archive.manifest().count() == 2 and archive.cold("log", 0, 3).inputFiles() and all("000000000-000000004" in f for f in archive.cold("log", 0, 3).inputFiles())
    assert archive.tables().transactions.count() == t.transactions.count() and archive.height() == 12
    plan = archive.cold("log").where(F.col("address") == b"x" * 20)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(address), EqualTo(address" in plan
    a, topic = (b"a" * 20, b"b" * 20), (b"t" * 32, b"u" * 32)
    scan = lambda df: [x for x in df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").split("\n") if "PushedFilters" in x]
    logs = scan(archive.tables().logs.where(any_log([LogSelection(a, (topic,)), LogSelection(a[:1])])))
    assert len(logs) == 1, logs
    assert all(x in logs[0] for x in ("In(address, ", "In(topic0, ", "EqualTo(address,["))
    txs = scan(archive.tables().transactions.where(any_transaction([TransactionSelection(source=a, dest=a[:1]), TransactionSelection(sighash=(b"1234",))])))
    assert len(txs) == 1, txs
    assert all(x in txs[0] for x in ("In(source, ", "EqualTo(dest,[", "EqualTo(sighash,["))
    (tmp_path / "cold/tx/folder=blk000000004-000000012/_SUCCESS").unlink()
    assert archive.manifest().count() == 1  # a folder of which a table isn't whole doesn't count


@pytest.mark.parametrize("version", legacy.VERSIONS)
def test_older_formats(spark, tmp_path, version):
    t = tables(spark, chain())
    b, x = t.blocks, t.transactions.drop("sighash")
    if version == "0.0.39":
        for c in legacy.INT64["block"]:
            b = b.withColumn(c, F.lit(300).cast("long"))
        for c in legacy.INT64["transaction"]:
            x = x.withColumn(c, F.lit(300).cast("long"))
        x = x.withColumn("kind", F.lit(0).cast("long")).drop("status")
    for name, df in (("block", b), ("tx", x), ("log", t.logs)):
        df.write.parquet(f"{tmp_path}/blk000000000-000000012/{name}.parquet")
    for entity, schema, n in (("block", BLOCKS, 12), ("transaction", TRANSACTIONS, x.count()), ("log", LOGS, t.logs.count())):
        got = legacy.read_folders(spark, str(tmp_path), entity, version)
        assert {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in schema} and len(got.collect()) == n
    archive = Archive(spark, f"file://{tmp_path}/new", WriteOptions(folder_blocks=5))
    assert import_older(spark, archive, str(tmp_path), version) == 12 == archive.height() and archive.manifest().count() == 3
    assert archive.tables().logs.count() == t.logs.count() and import_older(spark, archive, str(tmp_path), version) == 12
    t.blocks.write.parquet(f"{tmp_path}/blk000000012-000000013/block.parquet")  # not whole
    assert legacy.read_folders(spark, str(tmp_path), "block", version).count() == 12
    stream = legacy.stream_folders(spark, str(tmp_path), "log", version)
    q = stream.writeStream.format("memory").queryName(f"older{version[-1]}").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table(f"older{version[-1]}").count() == t.logs.count()
    got = legacy.read_folders(spark, str(tmp_path), "transaction", version, start=6).collect()
    assert min(r.block_number for r in got) == 6 and any(r.sighash for r in got)
    if version == "0.0.39":
        assert {bytes(r.gas) for r in got} == {b"\x01\x2c"} and {r.v for r in got} == {Decimal(300)} and {r.status for r in got} == {None}
    for name in FILES:
        t.logs.write.parquet(f"{tmp_path}/blk000000020-000000030/{name}.parquet")
    with pytest.raises(ValueError, match="blocks 12 to 19 are missing"):
        legacy.read_folders(spark, str(tmp_path), "log", version)
    with pytest.raises(ValueError, match="unknown format"):
        legacy.source_schema("block", "9")


def test_forwarder():
    f = Forwarder("http://a", fake.transport, per_second=None, retry=rpc.Retry(1, 0), max_batch=2)
    assert f(rpc.best_block())["result"] == hex(fake.TIP) and f(rpc.best_block(), "http://b")["result"] == hex(fake.TIP - 2)
    assert sorted(r["id"] for r in f([rpc.best_block(i) for i in range(5)])) == list(range(5))
    assert 'requests_total{endpoint="http://a"} 6' in f.metrics.encode()
    assert json.loads(forwarder_routes(f)["POST", "/"](json.dumps(rpc.best_block()).encode(), {}))["result"] == hex(fake.TIP)
    with pytest.raises(rpc.RpcError):
        Forwarder(None, fake.transport)(rpc.best_block())
    with pytest.raises(rpc.RpcError):
        Forwarder("http://a", fake.transport, per_second=1)([rpc.best_block(i) for i in range(2)])


def test_metrics():
    m = Metrics()
    m.set("write_height", 12)
    assert "write_height 12" in m.encode() and m.encode().endswith("# EOF\n") and IngestListener(m).metrics is m
    with pytest.raises(KeyError):
        m.set("other", 1)
