"""Every operator as a query over the test tables, with the SQL that it must agree with."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DecimalType

from .adapters import testdata as t
from .functions import codec
from .operators import endpoints, manifest, relations
from .operators.predicates import LogSelection, TransactionSelection, any_log, any_transaction, block_range, log_matches, sure, transaction_matches
from .plans.compile import matched, projected, response_rows
from .plans.paging import page_by_size
from .plans.query import Query, make_query
from .schema import LOGS as LOG_SCHEMA
from .schema import TOPICS, TRANSACTIONS
from .sources import legacy
from .sources.storage import Archive, WriteOptions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_tables: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (t.SQL if with_tables else "") + sql
        return f

    return add


def topic(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Binary as hex, decimals as strings."""
    out = []
    for c in columns or df.columns:
        kind = df.schema[c].dataType
        out.append(codec.to_hex(F.col(c)).alias(c) if isinstance(kind, BinaryType) else F.col(c).cast("string").alias(c) if isinstance(kind, DecimalType) else F.col(c))
    return df.select(*out)


ADDRESSES = tuple(t.address(i) for i in (3, 7, 11))
LOGS = (
    LogSelection(ADDRESSES, ((topic("click"), topic("view")),)),
    LogSelection((), ((topic("purchase"),), (), (topic("5"), topic("6")))),
    LogSelection((t.address(2),), ()),
)
TXS = (
    TransactionSelection(source=(t.address(5), t.address(9)), dest=(t.address(12), t.address(40)), status=1),
    TransactionSelection(sighash=(b"RRRR",), source=(t.address(7),)),
)
ALL = {"block": frozenset(("number", "hash", "miner")), "transaction": frozenset(("from", "to", "hash")), "log": frozenset(("address", "topics"))}
A = lambda *ids: ", ".join(f"'0x{i:040x}'" for i in ids)
H = lambda *texts: ", ".join(f"'0x{topic(x).hex()}'" for x in texts)
LOG_SQL = f"""((address IN ({A(3, 7, 11)}) AND topic0 IN ({H("click", "view")}))
  OR (topic0 IN ({H("purchase")}) AND topic2 IN ({H("5", "6")})) OR address IN ({A(2)}))"""
TX_SQL = f"""(((source IN ({A(5, 9)}) OR dest IN ({A(12, 40)})) AND (status IS NULL OR status = 1))
  OR (coalesce(sighash = '0x52525252', false) AND source IN ({A(7)})))"""
LOG_COLUMNS = ("block_number", "log_index", "transaction_index", "address", *TOPICS)
TX_COLUMNS = ("block_number", "transaction_index", "source", "dest", "sighash", "status")
LOG_LIST, TX_LIST = ", ".join(LOG_COLUMNS), ", ".join(TX_COLUMNS)
UNION = f"""{t.SQL}, ml AS (SELECT * FROM logs WHERE {LOG_SQL}),
mt AS (SELECT * FROM transactions t WHERE {TX_SQL} OR EXISTS (
  SELECT 1 FROM ml WHERE ml.block_number = t.block_number AND ml.transaction_index = t.transaction_index))"""


def whole(logs=LOGS, txs=TXS, every=False) -> Query:
    q = make_query(0, None, logs, txs, every)
    return Query(q.first, q.end, q.logs, q.transactions, q.include_all_blocks, ALL)


@query("SELECT number, hash, miner FROM blocks WHERE number >= 100 AND number < 900")
def block_range_scan(spark, d):
    return shown(t.blocks(spark, d).where(block_range("number", 100, 900)), "number", "hash", "miner")


@query(f"SELECT {LOG_LIST} FROM logs WHERE address IN ({A(3, 7, 11)})")
def log_filter_address(spark, d):
    return shown(t.logs(spark, d).where(log_matches(LogSelection(ADDRESSES))), *LOG_COLUMNS)


@query(f"SELECT {LOG_LIST} FROM logs WHERE topic0 IN ({H('error', 'signup')}) AND topic2 IN ({H(*map(str, range(40)))})")
def log_filter_topics(spark, d):
    s = LogSelection((), ((topic("error"), topic("signup")), (), tuple(topic(str(i)) for i in range(40))))
    return shown(t.logs(spark, d).where(log_matches(s)), *LOG_COLUMNS)


@query(f"SELECT {LOG_LIST} FROM logs WHERE {LOG_SQL}")
def log_multi_selection(spark, d):
    return shown(t.logs(spark, d).where(any_log(LOGS)), *LOG_COLUMNS)


_DEEP = LogSelection((), ((topic("view"),), (), (), tuple(topic(f"view{i}") for i in range(50))))
_DEEP_SQL = f"topic0 IN ({H('view')}) AND (topic3 IN ({H(*(f'view{i}' for i in range(50)))}){{}})"


@query(f"SELECT block_number, log_index, coalesce({_DEEP_SQL.format('')}, false) AS strict, {_DEEP_SQL.format(' OR topic3 IS NULL')} AS literal FROM logs")
def log_topics_strict_vs_literal(spark, d):
    return t.logs(spark, d).select("block_number", "log_index", sure(log_matches(_DEEP)).alias("strict"), sure(log_matches(_DEEP, "literal")).alias("literal"))


_SIDES = TransactionSelection(source=tuple(t.address(i) for i in range(10)), dest=tuple(t.address(i) for i in range(10, 60)))


def _sides_sql(word: str) -> str:
    return f"SELECT {TX_LIST} FROM transactions WHERE source IN ({A(*range(10))}) {word} dest IN ({A(*range(10, 60))})"


@query(_sides_sql("OR"))
def tx_filter_from_to_or(spark, d):
    return shown(t.transactions(spark, d).where(transaction_matches(_SIDES)), *TX_COLUMNS)


@query(f"SELECT {TX_LIST} FROM ({_sides_sql('AND').replace('SELECT ' + TX_LIST, 'SELECT *')}) WHERE sighash IS NOT NULL")
def tx_filter_from_to_literal(spark, d):
    return shown(t.transactions(spark, d).where(transaction_matches(_SIDES, "literal")), *TX_COLUMNS)


@query(f"SELECT {TX_LIST} FROM transactions WHERE sighash IN ('0x52525252', '0x4e4e4e4e')")
def tx_filter_sighash(spark, d):
    return shown(t.transactions(spark, d).where(transaction_matches(TransactionSelection(sighash=(b"RRRR", b"NNNN")))), *TX_COLUMNS)


@query(f"SELECT {TX_LIST} FROM transactions WHERE status IS NULL OR status = 0")
def tx_filter_status(spark, d):
    return shown(t.transactions(spark, d).where(transaction_matches(TransactionSelection(status=0))), *TX_COLUMNS)


@query(f"SELECT {TX_LIST} FROM transactions WHERE {TX_SQL}")
def tx_multi_selection(spark, d):
    return shown(t.transactions(spark, d).where(any_transaction(TXS)), *TX_COLUMNS)


@query(f""", ml AS (SELECT * FROM logs WHERE {LOG_SQL})
SELECT {TX_LIST} FROM transactions t WHERE EXISTS (
  SELECT 1 FROM ml WHERE ml.block_number = t.block_number AND ml.transaction_index = t.transaction_index)""")
def log_parent_txs(spark, d):
    return shown(relations.parent_transactions(t.transactions(spark, d), t.logs(spark, d).where(any_log(LOGS))), *TX_COLUMNS)


@query(f"{UNION} SELECT {TX_LIST} FROM mt", with_tables=False)
def tx_union_selected_and_parents(spark, d):
    return shown(matched(t.tables(spark, d), whole()).transactions, *TX_COLUMNS)


@query(f"""{UNION} SELECT number, hash, miner FROM blocks
WHERE number IN (SELECT block_number FROM ml UNION SELECT block_number FROM mt)""", with_tables=False)
def parent_blocks(spark, d):
    return shown(matched(t.tables(spark, d), whole()).blocks, "number", "hash", "miner")


@query(f"""{UNION} SELECT b.number, b.hash, (SELECT count(*) FROM mt WHERE block_number = b.number) AS n_transactions,
  (SELECT count(*) FROM ml WHERE block_number = b.number) AS n_logs FROM blocks b""", with_tables=False)
def include_all_blocks(spark, d):
    q = whole(every=True)
    r = projected(matched(t.tables(spark, d), q), q)
    n = relations.nested(r.blocks, r.transactions, r.logs)
    return n.select("number", codec.to_hex(F.col("block.hash")).alias("hash"), F.size("transactions").cast("long").alias("n_transactions"), F.size("logs").cast("long").alias("n_logs"))


@query(f"""{UNION},
tn AS (SELECT block_number, count(*) AS n, string_agg(hash, ',' ORDER BY transaction_index) AS h FROM mt GROUP BY 1),
ln AS (SELECT block_number, count(*) AS n, string_agg(address || ':' || log_index, ',' ORDER BY log_index) AS a FROM ml GROUP BY 1)
SELECT number, hash AS block_hash, coalesce(tn.n, 0) AS n_transactions, coalesce(h, '') AS transaction_hashes,
  coalesce(ln.n, 0) AS n_logs, coalesce(a, '') AS log_addresses
FROM blocks LEFT JOIN tn ON tn.block_number = number LEFT JOIN ln ON ln.block_number = number
WHERE tn.n > 0 OR ln.n > 0""", with_tables=False)
def nested_block_response(spark, d):
    q = whole()
    r = projected(matched(t.tables(spark, d), q), q)
    n = relations.nested(r.blocks, r.transactions, r.logs)
    hashes = F.array_join(F.transform("transactions", lambda x: codec.to_hex(x["hash"])), ",")
    places = F.array_join(F.transform("logs", lambda x: F.concat(codec.to_hex(x["address"]), F.lit(":"), x["log_index"].cast("string"))), ",")
    return n.select(
        "number",
        codec.to_hex(F.col("block.hash")).alias("block_hash"),
        F.size("transactions").cast("long").alias("n_transactions"),
        hashes.alias("transaction_hashes"),
        F.size("logs").cast("long").alias("n_logs"),
        places.alias("log_addresses"),
    )


@query(f"""{UNION}, j AS (
  SELECT number, '{{"block":{{"miner":"' || miner || '","number":' || number || ',"hash":"' || hash || '"}},"transactions":[' ||
    coalesce((SELECT string_agg('{{"to":"' || dest || '","from":"' || source || '","hash":"' || hash || '"}}', ',' ORDER BY transaction_index)
      FROM mt WHERE block_number = number), '') || '],"logs":[' ||
    coalesce((SELECT string_agg('{{"address":"' || address || '","topics":["' || concat_ws('","', topic0, topic1, topic2, topic3) || '"]}}', ','
      ORDER BY log_index) FROM ml WHERE block_number = number), '') || ']}}' AS entry FROM blocks)
SELECT number, entry FROM j WHERE number IN (SELECT block_number FROM ml UNION SELECT block_number FROM mt)""", with_tables=False)
def response_json(spark, d):
    return response_rows(t.tables(spark, d), whole())


@query(f""", ml AS (SELECT * FROM logs WHERE {LOG_SQL})
SELECT block_number, log_index, address, topic0, topic1, topic2, topic3 FROM ml""")
def field_selection_union(spark, d):
    """One selection asks for addresses, another for topics: all rows get both."""
    fields = ({"log": frozenset(("address",))}, {"log": frozenset(("topics",))}, {})
    logs = [LogSelection(s.address, s.topics, f) for s, f in zip(LOGS, fields, strict=True)]
    q = make_query(0, None, logs)
    return shown(projected(matched(t.tables(spark, d), q), q).logs)


@query("""SELECT l_orderkey, l_suppkey, l_returnflag,
  CASE WHEN NOT (l_returnflag = 'R' AND l_suppkey % 2 = 0) THEN '0x' || lower(to_hex(encode(repeat(l_returnflag, 4)))) END AS sighash
FROM lineitem""", with_tables=False)
def derive_sighash(spark, d):
    plain = (F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 2 == 0)
    data = F.encode(F.when(plain, F.lit("RRR")).otherwise(F.repeat("l_returnflag", 9)), "utf-8")
    return t.load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", codec.to_hex(codec.sighash(data)).alias("sighash"))


@query("""SELECT block_number, log_index, concat_ws(',', topic0, topic1, topic2, topic3) AS topics,
  topic0, topic1, coalesce(topic2, topic3) AS topic2, CASE WHEN topic2 IS NOT NULL THEN topic3 END AS topic3 FROM logs""")
def topics_array_roundtrip(spark, d):
    topics = codec.topics_array(*map(F.col, TOPICS))
    rows = t.logs(spark, d).select("block_number", "log_index", topics.alias("all"))
    joined = F.array_join(F.transform("all", codec.to_hex), ",")
    return shown(rows.select("block_number", "log_index", joined.alias("topics"), *codec.topics_split(F.col("all"))))


@query("""SELECT o_orderkey, '0x' || sha256(CAST(o_orderkey AS VARCHAR)) AS fixed, CAST(o_orderkey % 3 = 0 AS BOOLEAN) AS rejected,
  CASE WHEN length(to_hex(o_orderkey)) % 2 = 1 THEN '0x0' ELSE '0x' END || lower(to_hex(o_orderkey)) AS padded,
  CAST(o_orderkey AS VARCHAR) AS u64_of_hex, CAST(o_custkey AS VARCHAR) AS u64_of_digits, o_orderkey AS u32, '0x' || lower(to_hex(o_orderkey)) AS number
FROM orders""", with_tables=False)
def hex_roundtrip(spark, d):
    key = F.col("o_orderkey")
    text = F.concat(F.lit("0x"), F.sha2(key.cast("string"), 256))
    number = codec.number_to_hex(key)
    cut = F.when(key % 3 == 0, F.substring(text, 1, 65)).otherwise(text)
    return t.load(spark, d, "orders").select(
        "o_orderkey",
        codec.to_hex(codec.hex_to_fixed(text, 32, strict=True)).alias("fixed"),
        codec.hex_to_fixed(cut, 32).isNull().alias("rejected"),
        codec.to_hex(codec.hex_to_bytes(number, strict=True)).alias("padded"),
        codec.render_u64(codec.parse_u64(number, strict=True)).alias("u64_of_hex"),
        codec.render_u64(codec.parse_u64(F.col("o_custkey").cast("string"))).alias("u64_of_digits"),
        codec.parse_u32(number, strict=True).alias("u32"),
        number.alias("number"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN length(to_hex(l_partkey)) % 2 = 1 THEN '0x0' ELSE '0x' END || lower(to_hex(l_partkey)) AS bytes,
  CAST(l_partkey AS VARCHAR) AS back, l_orderkey * 16 + l_linenumber AS combined FROM lineitem""", with_tables=False)
def int_to_min_bytes(spark, d):
    b = codec.int_to_bytes(F.col("l_partkey"))
    key = codec.combined_key(F.col("l_orderkey"), F.col("l_linenumber"))
    return t.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", codec.to_hex(b).alias("bytes"), codec.bytes_to_u64(b).cast("string").alias("back"), key.alias("combined"))


@query("""SELECT number, CASE WHEN number < 1000 THEN 'cold' ELSE 'hot' END AS tier, hash FROM blocks""")
def hot_cold_union(spark, d):
    """Both tiers hold blocks 700 to 1200; the height decides."""
    b = t.blocks(spark, d)
    cold = b.where("number < 1200").withColumn("tier", F.lit("cold"))
    hot = b.where("number >= 700").withColumn("tier", F.lit("hot"))
    return shown(relations.hot_and_cold(cold, hot, "number", 1000), "number", "tier", "hash")


@query("""SELECT max(CASE WHEN o_orderkey < 1000 THEN o_orderkey // 500 * 500 + 500 END) AS parquet_height,
  min(CASE WHEN o_orderkey >= 900 THEN o_orderkey END) AS db_tail,
  max(o_orderkey) + 1 AS db_height, max(o_orderkey) + 1 AS height FROM orders""", with_tables=False)
def archive_height(spark, d):
    b = t.blocks(spark, d)
    folders = _folders(b.where("number < 1000"))
    return manifest.heights(folders, b.where("number >= 900"))


def _folders(blocks: DataFrame) -> DataFrame:
    """A manifest with a folder for each 500 blocks, by way of its names."""
    first = (F.floor(F.col("number") / 500) * 500).cast("long")
    names = blocks.select(manifest.folder_name(first, first + 500).alias("name")).distinct()
    return manifest.parse_folders(names).select("from", "to", "is_temp", F.col("name").alias("path"))


FOLDERS_SQL = "WITH f AS (SELECT DISTINCT o_orderkey // 500 * 500 AS \"from\", o_orderkey // 500 * 500 + 500 AS \"to\" FROM orders{}) "


@query(FOLDERS_SQL.format("") + """SELECT "from", "to", false AS is_temp, printf('blk%09d-%09d', "from", "to") AS path,
  greatest("from", 750) AS clip_from, least("to", 1321) AS clip_to FROM f WHERE "from" < 1321 AND "to" > 750""", with_tables=False)
def manifest_overlap(spark, d):
    return manifest.overlapping(_folders(t.blocks(spark, d)), 750, 1321)


@query(FOLDERS_SQL.format("") + 'SELECT min("from") AS "from", max("to") AS "to" FROM f', with_tables=False)
def range_hull(spark, d):
    return manifest.hull(_folders(t.blocks(spark, d)))


#: Folders in their order, without the one at 1000, and whether a folder lacks its predecessor.
RUNS_SQL = FOLDERS_SQL.format("") + """, g AS (SELECT "from", "to", lag("to") OVER (ORDER BY "from") AS before FROM f WHERE "from" <> 1000),
r AS (SELECT *, coalesce(before <> "from", false) AS gap FROM g) """


@query(RUNS_SQL + 'SELECT coalesce(min(before) FILTER (WHERE gap), max("to"), 0) AS start_block FROM r', with_tables=False)
def manifest_gap_start(spark, d):
    return manifest.resume_block(_folders(t.blocks(spark, d)).where("`from` <> 1000"))


@query(RUNS_SQL + """SELECT "from", "to" FROM (SELECT *, count(*) FILTER (WHERE gap) OVER (ORDER BY "from") AS n FROM r WHERE "from" >= 500)
  WHERE n = 0 AND EXISTS (SELECT 1 FROM r WHERE "from" = 500)""", with_tables=False)
def contiguous_run(spark, d):
    return manifest.contiguous_run(_folders(t.blocks(spark, d)).where("`from` <> 1000"), 500)


@query(RUNS_SQL + 'SELECT before AS "from", "from" AS "to" FROM r WHERE gap', with_tables=False)
def manifest_gaps(spark, d):
    return manifest.gaps(_folders(t.blocks(spark, d)).where("`from` <> 1000"))


@query("""SELECT o_custkey AS custkey, max(o_orderkey) AS orderkey, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1""", with_tables=False)
def dedupe_last_wins(spark, d):
    rows = t.load(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"))
    return relations.last_wins(rows, ["custkey"], "orderkey")


_COUNTS = ", ".join(f"(SELECT count(*) FROM {n} x WHERE x.{c} >= 200 AND x.{c} <= b.number) AS {k}" for k, n, c in (("nb", "blocks", "number"), ("nt", "transactions", "block_number"), ("nl", "logs", "block_number")))


@query(f"SELECT min(number) + 1 AS roll_end FROM (SELECT b.number, {_COUNTS} FROM blocks b WHERE b.number >= 200 AND b.number < 700) WHERE nb >= 500 OR nt >= 600 OR nl >= 600")
def folder_roll(spark, d):
    return relations.roll_end(t.blocks(spark, d), t.transactions(spark, d), t.logs(spark, d), 200, 500, 600)


@query(f"SELECT {TX_LIST} FROM transactions WHERE {TX_SQL} AND block_number >= 100 AND block_number < 700")
def archive_selected_transactions(spark, d):
    """Written into a new archive of three folders, and read back through it."""
    archive = _new_archive(spark)
    blocks, txs, logs = t.blocks(spark, d), t.transactions(spark, d), t.logs(spark, d)
    for first in (0, 300, 600):
        archive.write_folder(first, first + 300, blocks, txs, logs)
    tables = archive.tables(100, 700)
    return shown(tables.transactions.where(block_range("block_number", 100, 700) & any_transaction(TXS)), *TX_COLUMNS)


def _files(spark, d) -> DataFrame:
    """Objects of the archive: every third folder lacks its logs."""
    name = F.col("path")
    each = _folders(t.blocks(spark, d)).select(name, "from", F.explode(F.array(*map(F.lit, manifest.FILES))).alias("file"))
    return each.where((F.col("file") != "log") | (F.floor(F.col("from") / 500) % 3 != 0)).select(F.concat_ws("/", F.lit("data"), "path", F.concat("file", F.lit(".parquet"))).alias("key"))


@query(FOLDERS_SQL.format("") + 'SELECT "from", "to" FROM f WHERE "from" // 500 % 3 <> 0 AND "to" > 700', with_tables=False)
def folder_completeness(spark, d):
    return manifest.complete_folders(manifest.parse_object_key(_files(spark, d)), 700)


@query(FOLDERS_SQL.format("") + """SELECT 'data/' || printf('blk%09d-%09d', "from", "to") || '/log.parquet' AS key FROM f WHERE "from" // 500 % 3 = 0""", with_tables=False)
def missing_files_anti(spark, d):
    want = _folders(t.blocks(spark, d)).select(F.explode(F.array(*(F.concat(F.lit("data/"), "path", F.lit(f"/{f}.parquet")) for f in manifest.FILES))).alias("key"))
    return manifest.missing_files(_files(spark, d), want)


def _rpc_blocks(spark, d) -> DataFrame:
    """Blocks that nest their transactions, as nodes send them."""
    tx = t.transactions(spark, d).drop("sighash", "status")
    return tx.groupBy(F.col("block_number").alias("number")).agg(F.collect_list(F.struct(*tx.columns)).alias("transactions"))


@query("SELECT block_number, transaction_index, source, dest, sighash FROM transactions")
def flatten_block_txs(spark, d):
    return shown(relations.with_sighash(relations.flatten_transactions(_rpc_blocks(spark, d))), "block_number", "transaction_index", "source", "dest", "sighash")


@query("SELECT block_number, transaction_index, source, status FROM transactions")
def receipts_join_status(spark, d):
    tx = t.transactions(spark, d)
    receipts = tx.select("block_number", "transaction_index", "status", F.array(F.struct("block_number", F.lit(0).alias("log_index"))).alias("logs"))
    _, statuses = relations.flatten_receipts(receipts)
    return shown(relations.with_status(tx.drop("status"), statuses), "block_number", "transaction_index", "source", "status")


@query("""SELECT block_number, log_index, topic0, topic1, topic2, topic3 FROM logs""")
def flatten_receipt_logs(spark, d):
    topics = F.array(*map(F.col, TOPICS))
    log = F.struct("block_number", "log_index", topics.alias("topics"))
    receipts = t.logs(spark, d).groupBy("block_number", "transaction_index").agg(F.collect_list(log).alias("logs")).withColumn("status", F.lit(1))
    return shown(relations.flatten_receipts(receipts)[0], "block_number", "log_index", *TOPICS)


@query(""", sized AS (
  SELECT number, 500 + 200 * (SELECT count(*) FROM transactions WHERE block_number = number)
    + 150 * (SELECT count(*) FROM logs WHERE block_number = number) AS size FROM blocks),
cut AS (SELECT *, coalesce(sum(size) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT number, size FROM cut WHERE before < 900000""")
def page_by_response_size(spark, d):
    tx = t.transactions(spark, d).groupBy("block_number").agg(F.count("*").alias("n_tx"))
    logs = t.logs(spark, d).groupBy("block_number").agg(F.count("*").alias("n_log"))
    b = t.blocks(spark, d).select("number")
    b = b.join(tx, b.number == tx.block_number, "left").drop("block_number").join(logs, b.number == logs.block_number, "left")
    size = 500 + 200 * F.coalesce("n_tx", F.lit(0)) + 150 * F.coalesce("n_log", F.lit(0))
    return page_by_size(b.select("number", size.alias("size")), "number", "size", 900_000, bucket=1_000)


@query("""SELECT block_number // 1000 AS part, min(block_number) AS min_block_number, max(block_number) AS max_block_number,
  count(DISTINCT block_number) AS n_block_number, min(address) AS min_address, max(address) AS max_address, count(DISTINCT address) AS n_address
FROM logs GROUP BY 1""")
def row_group_stats(spark, d):
    part = F.floor(F.col("block_number") / 1000).alias("part")
    return shown(manifest.column_ranges(t.logs(spark, d), [part], "block_number", "address"))


_HEIGHTS = "SELECT c_nationkey AS k, max(c_custkey) AS height FROM customer GROUP BY 1"


@query(f"""WITH e AS (SELECT 'node-' || k AS endpoint, height FROM ({_HEIGHTS})), h AS (SELECT * FROM e WHERE height >= (SELECT max(height) FROM e) - 20)
SELECT endpoint, height, (SELECT min(height) FROM h) AS tip FROM h""", with_tables=False)
def endpoint_health(spark, d):
    e = t.load(spark, d, "customer").groupBy("c_nationkey").agg(F.max("c_custkey").alias("height"))
    return endpoints.healthy(e.select(F.concat(F.lit("node-"), F.col("c_nationkey").cast("string")).alias("endpoint"), "height"), 20)


@query("""WITH r AS (SELECT date_trunc('second', ts) AS second, event_type AS endpoint, count(*) AS n FROM events GROUP BY 1, 2)
SELECT second, endpoint, n FROM r UNION ALL SELECT second, NULL, CAST(sum(n) AS BIGINT) FROM r GROUP BY 1""", with_tables=False)
def request_rate_window(spark, d):
    requests = t.load(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("endpoint"))
    return endpoints.request_rates(requests).withColumn("second", F.col("second").cast("timestamp_ntz"))


def _new_archive(spark: SparkSession) -> Archive:
    """An empty archive in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="archives-")
    return Archive(spark, f"{base}/archive-{uuid.uuid4().hex}", WriteOptions(folder_blocks=5_000))


def _full_logs(logs: DataFrame) -> DataFrame:
    """Logs with every column of the archive; what the test tables lack is made of the key."""
    name = F.concat_ws("/", "block_number", "transaction_index")
    logs = logs.withColumn("block_hash", F.unhex(F.sha2(F.col("block_number").cast("string"), 256))).withColumn("transaction_hash", F.unhex(F.sha2(name, 256)))
    return logs.withColumn("removed", F.lit(False)).select(*LOG_SCHEMA.names)


@query(f"SELECT {LOG_LIST} FROM logs WHERE address IN ({A(3, 7, 11)}) AND block_number >= 300 AND block_number < 2200")
def parquet_archive_roundtrip(spark, d):
    """Logs written as two sorted folders with blooms, and read back by range and address."""
    archive, logs = _new_archive(spark), _full_logs(t.logs(spark, d))
    none = spark.createDataFrame([], TRANSACTIONS)
    blocks = spark.createDataFrame([], "number long")
    for first, end in ((0, 1_000), (1_000, 1 << 31)):
        archive.write_folder(first, end, blocks, none, logs)
    found = archive.cold("log", 300, 2_200).where(block_range("block_number", 300, 2_200))
    return shown(found.where(log_matches(LogSelection(ADDRESSES))), *LOG_COLUMNS)


@query(f"SELECT {LOG_LIST} FROM logs")
def stream_ingest_replay(spark, d):
    """Events as a stream into the hot tail, and what is there when it has ended."""
    archive = _new_archive(spark)
    source = spark.read.parquet(f"{d}/events.parquet")
    events = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")

    def batch(rows: DataFrame, _: int) -> None:
        archive.upsert_hot("log", _full_logs(t.logs_of(rows)))

    stream = events.writeStream.foreachBatch(batch).option("checkpointLocation", f"{archive.root}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return shown(archive.hot("log"), *LOG_COLUMNS)


_MIN_HEX = "CASE WHEN length(to_hex({0})) % 2 = 1 THEN '0x0' ELSE '0x' END || lower(to_hex({0}))"


@query(f"""SELECT block_number, transaction_index, {_MIN_HEX.format("gas")} AS gas, CAST(gas + 27 AS VARCHAR) AS v, CAST(NULL AS BIGINT) AS status, sighash FROM transactions""")
def legacy_int64_transactions(spark, d):
    """Transactions of the older format, whose numbers are signed 64-bit, as today's."""
    tx, quantity = t.transactions(spark, d), F.conv(F.hex("gas"), 16, 10).cast("long")
    old = tx.withColumns({"gas": quantity, "gas_price": quantity, "v": quantity + 27, "kind": F.lit(0).cast("long")})
    have = set(old.columns)
    schema = legacy.source_schema("transaction", "0.0.39")
    old = old.select(*(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    return shown(legacy.adapt(old, "transaction", "0.0.39"), "block_number", "transaction_index", "gas", "v", "status", "sighash")
