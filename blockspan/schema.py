"""The three tables: columns, their order on disk, and their names on the wire.

Unsigned 32-bit numbers are ``bigint`` and 64-bit ones ``decimal(20,0)``, which is what
Spark makes of them in Parquet; hashes, addresses and 256-bit numbers are ``binary``.
"""

from __future__ import annotations

from pyspark.sql.types import BinaryType, BooleanType, DecimalType, LongType, StructField, StructType

_TYPES = {"B": BinaryType(), "u32": LongType(), "u64": DecimalType(20, 0), "bool": BooleanType()}


def _table(columns: str) -> StructType:
    """From ``name:type`` or, where nulls may stand, ``name:type?``."""
    fields = (c.split(":") for c in columns.split())
    return StructType([StructField(n, _TYPES[t.rstrip("?")], t.endswith("?")) for n, t in fields])


#: The columns on disk, in their order.
BLOCKS = _table(
    "parent_hash:B sha3_uncles:B miner:B state_root:B transactions_root:B receipts_root:B logs_bloom:B difficulty:B?"
    " number:u32 gas_limit:B gas_used:B timestamp:B extra_data:B mix_hash:B? nonce:u64? total_difficulty:B?"
    " base_fee_per_gas:B? size:B hash:B?"
)
TRANSACTIONS = _table(
    "kind:u32? nonce:u64 dest:B? gas:B value:B input:B max_priority_fee_per_gas:B? max_fee_per_gas:B? y_parity:u32?"
    " chain_id:u32? v:u64? r:B? s:B? source:B? block_hash:B block_number:u32 transaction_index:u32 gas_price:B? hash:B"
    " status:u32? sighash:B?"
)
LOGS = _table(
    "address:B block_hash:B block_number:u32 data:B log_index:u32 removed:bool? topic0:B? topic1:B? topic2:B? topic3:B?"
    " transaction_hash:B transaction_index:u32"
)
TOPICS = ("topic0", "topic1", "topic2", "topic3")
KEYS = {"block": ["number"], "transaction": ["block_number", "transaction_index"], "log": ["block_number", "log_index"]}
TABLES = {"block": BLOCKS, "transaction": TRANSACTIONS, "log": LOGS}

#: Columns whose wire name is not their own in camel case.
RENAMED = {
    "block": {},
    "transaction": {"kind": "type", "dest": "to", "source": "from", "transaction_index": "index"},
    "log": {"log_index": "index"},
}


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def wire_name(entity: str, column: str) -> str:
    return RENAMED[entity].get(column, camel(column))


#: Selectable fields by wire name: the columns behind each.
FIELDS: dict[str, dict[str, tuple[str, ...]]] = {
    entity: {wire_name(entity, f.name): (f.name,) for f in table if f.name not in (*TOPICS, "sighash")} for entity, table in TABLES.items()
}
FIELDS["log"]["topics"] = TOPICS


def columns_of(entity: str, fields: set[str]) -> list[str]:
    """Columns behind selected wire fields, in table order."""
    wanted = {c for f in fields for c in FIELDS[entity].get(f, ())}
    return [f.name for f in TABLES[entity] if f.name in wanted]
