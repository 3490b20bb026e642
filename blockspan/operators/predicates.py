"""Row predicates of log and transaction selections.

They are plain comparisons, so that a scan's filter can take them to the Parquet reader:
where a column is null they may be null themselves, which a filter takes for false. Where
the truth itself is wanted, or its opposite, ``sure`` makes a column of it that is never
null.

``semantics="documented"`` is the default. ``"literal"`` has three deviations that some
archives show: a topic filter beyond a log's topics passes, sender and recipient filters
must both match (an empty one matching nothing beside a given one), and a transaction
without a selector never matches.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TOPICS


@dataclass(frozen=True)
class LogSelection:
    """Values are whatever the columns hold (binary in an archive)."""

    address: tuple = ()
    topics: tuple[tuple, ...] = ()
    fields: dict[str, frozenset[str]] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class TransactionSelection:
    source: tuple = ()
    dest: tuple = ()
    sighash: tuple = ()
    status: int | None = None
    fields: dict[str, frozenset[str]] = field(default_factory=dict, hash=False)


def within(column: str, values: Sequence) -> Column:
    """Membership; of a null value not known."""
    return F.col(column).isin(*values) if values else F.lit(False)


def sure(predicate: Column) -> Column:
    """True or false; what isn't known is false."""
    return F.coalesce(predicate, F.lit(False))


def block_range(column: str, first: int, end: int | None) -> Column:
    """first <= column < end; nothing keeps it from the scan."""
    low = F.col(column) >= first
    return low if end is None else low & (F.col(column) < end)


def _any(predicates: Iterable[Column]) -> Column:
    return reduce(or_, predicates, F.lit(False))


def log_matches(s: LogSelection, semantics: str = "documented") -> Column:
    tests = [within("address", s.address)] if s.address else []
    for name, values in zip(TOPICS, s.topics, strict=False):
        if values:
            test = within(name, values)
            tests.append(test if semantics == "documented" else test | F.col(name).isNull())
    return reduce(and_, tests, F.lit(True))


def transaction_matches(s: TransactionSelection, semantics: str = "documented") -> Column:
    tests = []
    if s.source or s.dest:
        sides = within("source", s.source), within("dest", s.dest)
        tests.append(sides[0] | sides[1] if semantics == "documented" else sides[0] & sides[1])
    if s.sighash:
        tests.append(within("sighash", s.sighash))
    elif semantics == "literal":
        tests.append(F.col("sighash").isNotNull())
    if s.status is not None:
        tests.append(F.col("status").isNull() | (F.col("status") == s.status))
    return reduce(and_, tests, F.lit(True))


def any_log(selections: Sequence[LogSelection], semantics: str = "documented") -> Column:
    return _any(log_matches(s, semantics) for s in selections)


def any_transaction(selections: Sequence[TransactionSelection], semantics: str = "documented") -> Column:
    return _any(transaction_matches(s, semantics) for s in selections)
