"""Joins, unions and nesting of the three tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import sighash, topics_split
from .predicates import sure

TX_KEY = ["block_number", "transaction_index"]


def parent_transactions(transactions: DataFrame, logs: DataFrame) -> DataFrame:
    """Transactions that at least one of the logs came from, each once."""
    return transactions.join(logs.select(*TX_KEY), TX_KEY, "left_semi")


def selected_or_parent(transactions: DataFrame, selected, logs: DataFrame) -> DataFrame:
    """Transactions that match ``selected`` and those that logs came from, each once.

    Rows that match are taken by the scan's filter; only the others are probed, so the two
    branches can't overlap and nothing needs to be deduplicated.
    """
    others = transactions.where(~sure(selected))
    return transactions.where(selected).unionByName(parent_transactions(others, logs))


def parent_blocks(blocks: DataFrame, *rows: DataFrame) -> DataFrame:
    """Blocks that any of the rows (by ``block_number``) belong to."""
    numbers = None
    for r in rows:
        own = r.select(F.col("block_number").alias("number"))
        numbers = own if numbers is None else numbers.unionByName(own)
    return blocks.join(numbers.distinct(), "number", "left_semi")


def last_wins(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Of the rows of a key the one with the highest sequence number."""
    values = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(sequence)).alias("__row"))
    return newest.select(*keys, *(F.col("__row")[c].alias(c) for c in values)).select(df.columns)


def hot_and_cold(cold: DataFrame, hot: DataFrame, column: str, height: int) -> DataFrame:
    """Immutable rows below the height, mutable ones from it on."""
    return cold.where(F.col(column) < height).unionByName(hot.where(F.col(column) >= height))


def roll_end(blocks: DataFrame, transactions: DataFrame, logs: DataFrame, first: int, max_blocks: int, max_rows: int) -> DataFrame:
    """One row, ``roll_end``: where a folder that begins at ``first`` ends, exclusive. It is
    the first place with ``max_blocks`` blocks, or ``max_rows`` transactions or logs, behind
    it; null if the rows don't reach any. A block is never split. At most ``max_blocks``
    counts are ordered as a whole."""

    def inside(df: DataFrame, number: str) -> DataFrame:
        return df.select(F.col(number).alias("number")).where((F.col("number") >= first) & (F.col("number") < first + max_blocks))

    kinds = (("b", blocks, "number"), ("t", transactions, "block_number"), ("l", logs, "block_number"))
    counts = [inside(df, n).groupBy("number").agg(*(F.count("*").alias(c) if c == k else F.lit(0).cast("long").alias(c) for c in "btl")) for k, df, n in kinds]
    each = counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("number").agg(*(F.sum(c).alias(c) for c in "btl"))
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    total = each.select("number", *(F.sum(c).over(upto).alias(c) for c in "btl"))
    full = (F.col("b") >= max_blocks) | (F.col("t") >= max_rows) | (F.col("l") >= max_rows)
    return total.where(full).agg((F.min("number") + 1).alias("roll_end"))


def flatten_transactions(blocks: DataFrame) -> DataFrame:
    """From blocks that nest their ``transactions`` to rows of transactions."""
    return blocks.select(F.explode("transactions").alias("t")).select("t.*")


def with_sighash(transactions: DataFrame) -> DataFrame:
    return transactions.withColumn("sighash", sighash(F.col("input")))


def flatten_receipts(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Logs (topics in four columns), and each transaction's status, from receipts."""
    logs = receipts.select(F.explode("logs").alias("l")).select("l.*")
    if "topics" in logs.columns:
        logs = logs.select(*(c for c in logs.columns if c != "topics"), *topics_split(F.col("topics")))
    return logs, receipts.select(*TX_KEY, "status")


def with_status(transactions: DataFrame, statuses: DataFrame) -> DataFrame:
    """Transactions with the status of their receipt; one without a receipt is an error."""
    found = statuses.select(*TX_KEY, F.col("status").alias("__status"), F.lit(True).alias("__found"))
    joined = transactions.drop("status").join(found, TX_KEY, "left")
    missing = F.raise_error(F.concat(F.lit("no receipt for transaction "), F.col("block_number"), F.lit("/"), F.col("transaction_index")))
    return joined.withColumn("status", F.when(F.col("__found"), F.col("__status")).otherwise(missing.cast("long"))).drop("__status", "__found")


def nested(blocks: DataFrame, transactions: DataFrame, logs: DataFrame) -> DataFrame:
    """A row for each block: ``number``, its columns as ``block``, and its rows as ordered
    lists ``transactions`` and ``logs``. A block's rows are one response entry; that bounds
    the lists."""

    def lists(df: DataFrame, order: str, name: str) -> DataFrame:
        row = F.struct(F.col(order).alias("__order"), F.struct(*df.columns).alias("row"))
        ordered = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"])
        return df.groupBy(F.col("block_number").alias("number")).agg(ordered.alias(name))

    out = blocks.select("number", F.struct(*blocks.columns).alias("block"))
    out = out.join(lists(transactions, "transaction_index", "transactions"), "number", "left")
    out = out.join(lists(logs, "log_index", "logs"), "number", "left")
    return out.select("number", "block", *(F.coalesce(c, F.array()).alias(c) for c in ("transactions", "logs")))


def sorted_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Order within partitions, nulls last: what writers need, without a shuffle."""
    return df.sortWithinPartitions(*(F.col(k).asc_nulls_last() for k in keys))


def running_total(df: DataFrame, order: str, size: str, bucket: int) -> DataFrame:
    """``df`` with ``before``: the sum of ``size`` over all rows ahead in ``order``.

    Rows are summed in ranges of ``bucket`` order values; the ranges' totals, a row each,
    are added up by themselves, so no task gets more than a range.
    """
    ranged = df.withColumn("__range", F.floor(F.col(order) / bucket))
    totals = ranged.groupBy("__range").agg(F.sum(size).alias("__total"))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(starts, "__range").withColumn("before", F.col("__start") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return out.drop("__range", "__start")
