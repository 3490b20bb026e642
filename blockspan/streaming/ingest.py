"""Ingest: from raw blocks of a node to the archive, as a stream.

Raw rows (``number``, ``block`` and ``receipts`` as JSON) are decoded with fixed schemas,
flattened into the three tables and upserted into the hot tail, batch by batch. A batch
that is tried again writes the same rows again. Once a range is whole, it is finalised
into a cold folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DecimalType, StringType, StructField, StructType

from ..functions.codec import hex_to_bytes, hex_to_fixed, parse_u32, parse_u64, sighash, topics_split
from ..operators.manifest import resume_block
from ..operators.relations import roll_end, with_status
from ..plans.compile import Tables
from ..schema import BLOCKS, LOGS, TOPICS, TRANSACTIONS, camel
from ..sources import legacy
from ..sources.storage import Archive
from .metrics import Metrics

#: How wide values of fixed width are, and names that nodes use.
WIDTH = {
    **{c: 32 for c in ("parent_hash", "sha3_uncles", "state_root", "transactions_root", "receipts_root", "mix_hash", "hash", "block_hash", "transaction_hash", *TOPICS)},
    **{c: 20 for c in ("miner", "dest", "source", "address")},
    "logs_bloom": 256,
}
RPC_NAMES = {"kind": "type", "dest": "to", "source": "from"}


def rpc_name(column: str) -> str:
    return RPC_NAMES.get(column, camel(column))


def _raw(columns: list[str]) -> list[StructField]:
    return [StructField(rpc_name(c), BooleanType() if c == "removed" else StringType()) for c in columns]


_TX = [f.name for f in TRANSACTIONS if f.name not in ("status", "sighash")]
_LOG = [f.name for f in LOGS if f.name not in TOPICS]
RAW_BLOCK = StructType([*_raw(BLOCKS.names), StructField("transactions", ArrayType(StructType(_raw(_TX))))])
RAW_LOG = StructType([*_raw(_LOG), StructField("topics", ArrayType(StringType()))])
RAW_RECEIPTS = ArrayType(StructType([*_raw(["block_number", "transaction_index", "status"]), StructField("logs", ArrayType(RAW_LOG))]))


def _value(column: str, kind, raw):
    if isinstance(kind, BooleanType):
        return raw
    if isinstance(kind, DecimalType):
        return parse_u64(raw, strict=True)
    if isinstance(kind, BinaryType):
        return hex_to_fixed(raw, WIDTH[column], strict=True) if column in WIDTH else hex_to_bytes(raw, strict=True)
    return parse_u32(raw, strict=True)


def _typed(rows: DataFrame, schema: StructType, skip: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(*(_value(f.name, f.dataType, F.col(f"r.{rpc_name(f.name)}")).alias(f.name) for f in schema if f.name not in skip))


def decode(raw: DataFrame) -> Tables:
    """The three tables from raw rows; anything that isn't as it should be is an error."""
    strict = {"mode": "FAILFAST"}
    parsed = raw.select(F.from_json("block", RAW_BLOCK, strict).alias("b"), F.from_json("receipts", RAW_RECEIPTS, strict).alias("rs"))
    blocks = _typed(parsed.select(F.col("b").alias("r")), BLOCKS)
    transactions = _typed(parsed.select(F.explode("b.transactions").alias("r")), TRANSACTIONS, ("status", "sighash"))
    receipts = parsed.select(F.explode("rs").alias("r"))
    statuses = receipts.select(*(parse_u32(F.col(f"r.{rpc_name(c)}"), strict=True).alias(c) for c in ("block_number", "transaction_index", "status")))
    logs = receipts.select(F.explode("r.logs").alias("r"))
    topics = [hex_to_fixed(c, 32, strict=True).alias(n) for c, n in zip(topics_split(F.col("r.topics")), TOPICS, strict=True)]
    plain = [_value(f.name, f.dataType, F.col(f"r.{rpc_name(f.name)}")).alias(f.name) for f in LOGS if f.name not in TOPICS]
    logs = logs.select(*plain, *topics).select(*LOGS.names)
    transactions = with_status(transactions, statuses).withColumn("sighash", sighash(F.col("input"))).select(*TRANSACTIONS.names)
    return Tables(blocks, transactions, logs)


def write_hot(archive: Archive, tables: Tables) -> None:
    """Blocks go last: a block that is there has its transactions and logs."""
    archive.upsert_hot("log", tables.logs)
    archive.upsert_hot("transaction", tables.transactions)
    archive.upsert_hot("block", tables.blocks)


def finalise_ready(archive: Archive) -> list[tuple[int, int]]:
    """Make cold folders of the hot ranges that are whole; their bounds."""
    step, done = archive.options.folder_blocks, []
    while True:
        h = archive.heights()
        first = h["parquet_height"]
        if not h["db_height"] or h["db_height"] <= first:
            return done
        hot = [archive.hot(e, first) for e in ("block", "transaction", "log")]
        end = roll_end(*hot, first, step, archive.options.folder_rows).first()[0]
        if end is None or hot[0].where((F.col("number") >= first) & (F.col("number") < end)).count() < end - first:
            return done
        archive.finalise(first, end)
        done.append((first, end))


def flush(archive: Archive) -> tuple[int, int] | None:
    """At the end of a finite source: the hot rest as a last, shorter folder."""
    h = archive.heights()
    first, end = h["parquet_height"], h["db_height"]
    if not end or end <= first:
        return None
    archive.finalise(first, end)
    return first, end


def start_block(archive: Archive, tip: int | None = None, initial_hot_blocks: int | None = None) -> int:
    """Where ingest goes on: behind what is there, or near the tip if only its range is
    wanted."""
    held = archive.height() or resume_block(archive.manifest()).first()["start_block"]
    return max(held, tip - initial_hot_blocks) if tip is not None and initial_hot_blocks is not None else held


def import_older(spark: SparkSession, archive: Archive, root: str, version: str) -> int:
    """Bring an older archive in as cold folders, from where this one ends; the block to go
    on from. Ranges are those of the archive's own folders, the last one perhaps shorter."""
    first = start_block(archive)
    older = {e: legacy.read_folders(spark, root, e, version, first) for e in ("block", "transaction", "log")}
    end = legacy.folders(spark, root, first).agg(F.coalesce(F.max("to"), F.lit(first))).first()[0]
    while first < end:
        upto = min(end, first + archive.options.folder_blocks)
        archive.write_folder(first, upto, older["block"], older["transaction"], older["log"])
        first = upto
    return first


def ingest(spark: SparkSession, raw: DataFrame, archive: Archive, checkpoint: str, finalise: bool = True, metrics: Metrics | None = None, tip: Callable[[], int] | None = None, **trigger) -> StreamingQuery:
    """Start the stream. ``tip`` tells the last block of the chain, for the metrics.
    ``trigger`` as in ``writeStream.trigger``, one pass by default."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        try:
            write_hot(archive, decode(rows))
        finally:
            rows.unpersist()
        if finalise:
            finalise_ready(archive)
        if metrics and (height := archive.height()):
            metrics.set("download_height", height - 1)
            metrics.set("write_height", height - 1)
        if metrics and tip:
            metrics.set("chain_height", tip())

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
