"""From a query to one lazy plan over the three tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DecimalType

from ..functions.codec import render_u64, to_hex, topics_array
from ..operators.predicates import any_log, any_transaction, block_range
from ..operators.relations import nested, parent_blocks, parent_transactions, selected_or_parent
from ..schema import TOPICS, columns_of, wire_name
from .query import Query


@dataclass(frozen=True)
class Tables:
    blocks: DataFrame
    transactions: DataFrame
    logs: DataFrame


@dataclass(frozen=True)
class Result:
    """Matched rows with all columns of their tables, not yet projected."""

    blocks: DataFrame
    transactions: DataFrame
    logs: DataFrame


def matched(tables: Tables, query: Query, semantics: str = "documented") -> Result:
    """Logs that match, transactions that match or are parents of these, and the blocks of
    both (or all in range). An entity without selections isn't scanned for matches."""
    logs = tables.logs.where(block_range("block_number", query.first, query.end))
    transactions = tables.transactions.where(block_range("block_number", query.first, query.end))
    blocks = tables.blocks.where(block_range("number", query.first, query.end))
    logs = logs.where(any_log(query.logs, semantics)) if query.logs else logs.limit(0)
    selected = any_transaction(query.transactions, semantics)
    if not query.include_all_blocks:
        # A parent's block is its log's, so the parents needn't be asked for theirs.
        rows = [logs] * bool(query.logs) + [transactions.where(selected)] * bool(query.transactions)
        blocks = parent_blocks(blocks, *rows) if rows else blocks.limit(0)
    if query.transactions and query.logs:
        transactions = selected_or_parent(transactions, selected, logs)
    elif query.transactions:
        transactions = transactions.where(selected)
    else:
        transactions = parent_transactions(transactions, logs)
    return Result(blocks, transactions, logs)


def projected(result: Result, query: Query) -> Result:
    """Selected fields and the columns that nesting needs."""

    def pick(df: DataFrame, entity: str, keys: list[str]) -> DataFrame:
        wanted = columns_of(entity, query.fields.get(entity, frozenset()))
        return df.select(*dict.fromkeys([*keys, *(c for c in wanted if c in df.columns)]))

    return Result(
        pick(result.blocks, "block", ["number"]),
        pick(result.transactions, "transaction", ["block_number", "transaction_index"]),
        pick(result.logs, "log", ["block_number", "log_index"]),
    )


def _wire(row: Column, df: DataFrame, entity: str, fields: frozenset[str]) -> Column:
    """A struct as it goes over the wire: hex, decimal strings, numbers; wire names."""
    out = []
    for name in columns_of(entity, fields):
        if name not in df.columns or name in TOPICS:
            continue
        kind = df.schema[name].dataType
        value = row[name]
        value = to_hex(value) if isinstance(kind, BinaryType) else render_u64(value) if isinstance(kind, DecimalType) else value
        out.append(value.alias(wire_name(entity, name)))
    if entity == "log" and "topics" in fields:
        topics = topics_array(*(row[t] for t in TOPICS))
        out.append(F.transform(topics, to_hex).alias("topics") if isinstance(df.schema["topic0"].dataType, BinaryType) else topics.alias("topics"))
    return F.struct(*out)


def _wire_list(name: str, df: DataFrame, entity: str, fields: frozenset[str]) -> Column:
    return F.transform(name, lambda row: _wire(row, df, entity, fields))


def response_rows(tables: Tables, query: Query, semantics: str = "documented") -> DataFrame:
    """``number, entry``: one JSON object a block, rows ordered within it.

    Nulls are left out. An entity of which no field is selected is left out as a whole: the
    key ``block`` then is missing, the lists stay empty.
    """
    r = projected(matched(tables, query, semantics), query)
    rows = nested(r.blocks, r.transactions, r.logs)
    parts = []
    if query.fields.get("block"):
        parts.append(_wire(F.col("block"), r.blocks, "block", query.fields["block"]).alias("block"))
    for name, df, entity in (("transactions", r.transactions, "transaction"), ("logs", r.logs, "log")):
        fields = query.fields.get(entity, frozenset())
        value = _wire_list(name, df, entity, fields) if fields else F.array().cast("array<string>")
        parts.append(value.alias(name))
    return rows.select("number", F.to_json(F.struct(*parts)).alias("entry"))
