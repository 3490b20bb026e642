"""Column functions between wire values and stored ones. All stay in the JVM.

``strict=True`` fails the query on a bad value; else it becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

U64 = (1 << 64) - 1


def _checked(ok: Column, value: Column, given: Column, strict: bool, what: str) -> Column:
    if not strict:
        return F.when(ok, value)
    return F.when(given.isNull() | F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"bad {what}: "), given)))


def hex_to_fixed(text: Column, width: int, strict: bool = False) -> Column:
    """``0x`` and exactly ``2 * width`` hex digits, to binary."""
    ok = text.rlike(f"^0x[0-9a-fA-F]{{{2 * width}}}$")
    return _checked(ok, F.unhex(F.when(ok, F.substr(text, F.lit(3)))), text, strict, f"{width}-byte value")


def hex_to_bytes(text: Column, strict: bool = False) -> Column:
    """``0x`` and any number of hex digits; an odd number gets a zero in front."""
    ok = text.rlike("^0x[0-9a-fA-F]*$")
    return _checked(ok, F.unhex(F.when(ok, F.substr(text, F.lit(3)))), text, strict, "hex value")


def to_hex(value: Column) -> Column:
    """Lower-case hex with ``0x``."""
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def parse_u64(text: Column, strict: bool = False) -> Column:
    """Hex with ``0x`` or decimal digits, to ``decimal(20,0)``."""
    is_hex = text.rlike("^0x0*[0-9a-fA-F]{1,16}$")
    digits = F.lpad(F.regexp_replace(F.substr(text, F.lit(3)), "^0+(?=.)", ""), 16, "0")
    from_hex = F.conv(F.when(is_hex, digits), 16, 10).cast(DecimalType(20, 0))
    from_decimal = F.when(text.rlike("^0*[0-9]{1,20}$"), F.regexp_replace(text, "^0+(?=.)", "").cast(DecimalType(38, 0)))
    value = F.when(is_hex, from_hex.cast(DecimalType(38, 0))).otherwise(from_decimal)
    return _checked(value <= F.lit(str(U64)).cast(DecimalType(38, 0)), value.cast(DecimalType(20, 0)), text, strict, "64-bit number")


def render_u64(value: Column) -> Column:
    return value.cast("string")


def parse_u32(text: Column, strict: bool = False) -> Column:
    """Hex digits, the prefix optional; always base 16."""
    ok = text.rlike("^(0x)?0*[0-9a-fA-F]{1,8}$")
    digits = F.regexp_replace(F.when(ok, text), "^(0x)?0*(?=.)", "")
    return _checked(ok, F.conv(digits, 16, 10).cast("long"), text, strict, "32-bit number")


def number_to_hex(value: Column) -> Column:
    """``0x`` and hex digits without leading zeros."""
    return F.concat(F.lit("0x"), F.lower(F.hex(value.cast("long"))))


def int_to_bytes(value: Column) -> Column:
    """Minimal big-endian bytes of a number >= 0 (one byte for zero); fails on others."""
    value = value.cast("long")
    return F.when(value < 0, F.raise_error(F.concat(F.lit("negative: "), value.cast("string")))).otherwise(F.unhex(F.hex(value)))


def int_to_u64(value: Column) -> Column:
    value = value.cast("long")
    return F.when(value < 0, F.raise_error(F.concat(F.lit("negative: "), value.cast("string")))).otherwise(value.cast(DecimalType(20, 0)))


def bytes_to_u64(value: Column) -> Column:
    """Numbers of at most eight bytes as ``decimal(20,0)``; larger ones are null."""
    small = F.when((F.octet_length(value) <= 8) & (F.octet_length(value) > 0), F.hex(value))
    return F.conv(small, 16, 10).cast(DecimalType(20, 0))


def sighash(data: Column) -> Column:
    """The first four bytes, or null where there are fewer."""
    return F.when(F.octet_length(data) >= 4, F.substring(data, 1, 4))


def topics_array(*topics: Column) -> Column:
    return F.array_compact(F.array(*topics))


def topics_split(topics: Column) -> list[Column]:
    return [F.get(topics, i).alias(f"topic{i}") for i in range(4)]


def combined_key(block: Column, index: Column) -> Column:
    """block * 16 + index, as an order-preserving bound; not unique beyond 16 a block."""
    return F.shiftleft(block.cast("long"), 4).bitwiseOR(index.cast("long"))
