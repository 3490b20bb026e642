"""The query object: from its JSON form, with all checks, to selections of rows."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from ..operators.predicates import LogSelection, TransactionSelection
from ..schema import FIELDS

ENTITIES = ("block", "transaction", "log")
U32 = (1 << 32) - 1


class QueryError(ValueError):
    """A query that can't be answered as it stands."""


@dataclass(frozen=True)
class Query:
    """``first`` inclusive, ``end`` exclusive (None: as far as the archive goes)."""

    first: int
    end: int | None = None
    logs: tuple[LogSelection, ...] = ()
    transactions: tuple[TransactionSelection, ...] = ()
    include_all_blocks: bool = False
    fields: dict[str, frozenset[str]] = field(default_factory=dict, hash=False)

    def checked(self) -> "Query":
        if self.end is not None and self.first >= self.end:
            raise QueryError("fromBlock must not be behind toBlock")
        if not self.logs and not self.transactions:
            raise QueryError("a query needs a log or transaction selection")
        return self


def merged_fields(selections) -> dict[str, frozenset[str]]:
    """Every field that any selection asks for, by entity: all rows get them all."""
    return {e: frozenset().union(*(s.fields.get(e, frozenset()) for s in selections)) for e in ENTITIES}


def make_query(first, end=None, logs=(), transactions=(), include_all_blocks=False) -> Query:
    return Query(first, end, tuple(logs), tuple(transactions), include_all_blocks, merged_fields([*logs, *transactions])).checked()


def _number(value, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= U32:
        raise QueryError(f"{name} must be a whole number from 0 to {U32}")
    return value


def _list(value, name: str) -> list:
    if value is None:
        return []
    if not isinstance(value, list):
        raise QueryError(f"{name} must be a list")
    return value


def _bytes(value, width: int, name: str) -> bytes:
    if not isinstance(value, str) or not re.fullmatch(f"0x[0-9a-fA-F]{{{2 * width}}}", value):
        raise QueryError(f"{name} must be 0x and {2 * width} hex digits")
    return bytes.fromhex(value[2:])


def _fields(value) -> dict[str, frozenset[str]]:
    if not isinstance(value, dict):
        raise QueryError("fieldSelection is missing")
    out = {}
    for entity in ENTITIES:
        own = value.get(entity) or {}
        if not isinstance(own, dict) or not all(isinstance(x, bool) for x in own.values()):
            raise QueryError(f"fieldSelection.{entity} must be an object of booleans")
        out[entity] = frozenset(k for k, on in own.items() if on and k in FIELDS[entity])
    return out


def parse_query(text: str | bytes | dict) -> Query:
    """A query from JSON. Unknown keys are passed over, as clients may know more."""
    try:
        body = text if isinstance(text, dict) else json.loads(text)
    except ValueError as e:
        raise QueryError(f"not JSON: {e}") from e
    if not isinstance(body, dict) or "fromBlock" not in body:
        raise QueryError("fromBlock is missing")
    logs, transactions = [], []
    for s in _list(body.get("logs"), "logs"):
        if not isinstance(s, dict) or not isinstance(s.get("topics"), list) or len(s["topics"]) > 4:
            raise QueryError("a log selection needs topics, at most four")
        topics = tuple(tuple(_bytes(x, 32, "topic") for x in _list(t, "topics")) for t in s["topics"])
        logs.append(LogSelection(tuple(_bytes(x, 20, "address") for x in _list(s.get("address"), "address")), topics, _fields(s.get("fieldSelection"))))
    for s in _list(body.get("transactions"), "transactions"):
        if not isinstance(s, dict) or ("to" in s and "address" in s):
            raise QueryError("a transaction selection is an object with either to or address")
        status = s.get("status")
        transactions.append(
            TransactionSelection(
                tuple(_bytes(x, 20, "from") for x in _list(s.get("from"), "from")),
                tuple(_bytes(x, 20, "to") for x in _list(s.get("to", s.get("address")), "to")),
                tuple(_bytes(x, 4, "sighash") for x in _list(s.get("sighash"), "sighash")),
                None if status is None else _number(status, "status"),
                _fields(s.get("fieldSelection")),
            )
        )
    last = body.get("toBlock")
    everything = body.get("includeAllBlocks", False)
    if not isinstance(everything, bool):
        raise QueryError("includeAllBlocks must be true or false")
    return make_query(_number(body["fromBlock"], "fromBlock"), None if last is None else _number(last, "toBlock") + 1, logs, transactions, everything)
