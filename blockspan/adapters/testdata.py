"""The star-schema test tables as an archive: orders are blocks, lineitems transactions,
events logs. Ids become 20-byte addresses, names 32-byte hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import int_to_bytes, sighash
from ..plans.compile import Tables

#: Lineitems have no key; this order makes the place of each within its order definite.
TX_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def address(number: int) -> bytes:
    return number.to_bytes(20, "big")


def _address(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), 40, "0"))


def _hash(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(p.cast("string") for p in parts)), 256))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("number"),
        _hash(F.lit("b"), F.col("o_orderkey")).alias("hash"),
        _hash(F.lit("b"), F.col("o_orderkey") - 1).alias("parent_hash"),
        _address(F.col("o_custkey")).alias("miner"),
        int_to_bytes(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("timestamp"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors are four letters of the return flag; plain transfers (flag R with an even
    supplier) have none. A status is missing for every fifth order.

    Places are counted by the column that block ranges are filtered by, so a range reaches
    the scan and only its rows are shuffled."""
    place = F.row_number().over(Window.partitionBy("block_number").orderBy(*TX_ORDER)) - 1
    plain = (F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 2 == 0)
    data = F.when(plain, F.lit("")).otherwise(F.concat(F.repeat("l_returnflag", 4), F.lpad(F.col("l_suppkey").cast("string"), 8, "0")))
    rows = load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "block_number").select(
        "block_number",
        place.cast("long").alias("transaction_index"),
        _address(F.col("l_suppkey")).alias("source"),
        _address(F.col("l_partkey")).alias("dest"),
        F.encode(data, "utf-8").alias("input"),
        F.when(F.col("block_number") % 5 != 0, F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).cast("long").alias("status"),
        int_to_bytes(F.col("l_quantity").cast("long")).alias("gas"),
        F.col("l_linenumber").cast("decimal(20,0)").alias("nonce"),
    )
    return rows.withColumn("sighash", sighash(F.col("input"))).withColumn("hash", _hash(F.lit("t"), F.col("block_number"), F.lit("/"), F.col("transaction_index")))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events a block, two to a transaction; topics 2 and 3 are missing for some."""
    return logs_of(load(spark, sf_dir, "events"))


def logs_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    e = F.col("event_id")
    return events.select(
        _address(F.col("user_id")).alias("address"),
        F.floor(e / 4).cast("long").alias("block_number"),
        (e % 4).alias("log_index"),
        (3 * (e % 2)).alias("transaction_index"),
        _hash(F.col("event_type")).alias("topic0"),
        _hash(k).alias("topic1"),
        F.when(e % 3 != 0, _hash(F.col("user_id"))).alias("topic2"),
        F.when(e % 6 == 1, _hash(F.col("event_type"), k)).alias("topic3"),
        F.encode("props", "utf-8").alias("data"),
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(blocks(spark, sf_dir), transactions(spark, sf_dir), logs(spark, sf_dir))


#: The same three tables in SQL, ids as hex strings.
SQL = """
WITH blocks AS (
  SELECT o_orderkey AS number, '0x' || sha256('b' || o_orderkey) AS hash, '0x' || sha256('b' || (o_orderkey - 1)) AS parent_hash,
    '0x' || lpad(lower(to_hex(o_custkey)), 40, '0') AS miner, o_orderdate
  FROM orders),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS idx
  FROM lineitem),
transactions AS (
  SELECT l_orderkey AS block_number, CAST(idx AS BIGINT) AS transaction_index,
    '0x' || lpad(lower(to_hex(l_suppkey)), 40, '0') AS source, '0x' || lpad(lower(to_hex(l_partkey)), 40, '0') AS dest,
    CASE WHEN l_returnflag = 'R' AND l_suppkey % 2 = 0 THEN NULL
      ELSE '0x' || lower(to_hex(encode(repeat(l_returnflag, 4)))) END AS sighash,
    CAST(CASE WHEN l_orderkey % 5 <> 0 THEN CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END END AS BIGINT) AS status,
    '0x' || sha256('t' || l_orderkey || '/' || idx) AS hash, CAST(l_quantity AS BIGINT) AS gas
  FROM numbered),
logs AS (
  SELECT '0x' || lpad(lower(to_hex(user_id)), 40, '0') AS address, event_id // 4 AS block_number, event_id % 4 AS log_index,
    3 * (event_id % 2) AS transaction_index, '0x' || sha256(event_type) AS topic0,
    '0x' || sha256(props->>'$.k') AS topic1,
    CASE WHEN event_id % 3 <> 0 THEN '0x' || sha256(CAST(user_id AS VARCHAR)) END AS topic2,
    CASE WHEN event_id % 6 = 1 THEN '0x' || sha256(event_type || (props->>'$.k')) END AS topic3
  FROM events)
"""
