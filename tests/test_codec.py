from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from blockspan.functions import codec
from blockspan.operators.manifest import folder_from_key, folder_key

#: Cases whose encoding is known.
HASH = "0x9d9af8e38d66c62e2c12f0225249fd9d721c54b83f48d9352c97c6cacdcb6f31"
ADDRESS = "0xe65ef515adc3fd724c326adf8212b4284fd10137"


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("text", "width"), [(HASH, 32), (ADDRESS, 20), ("0xfb0f3ee1", 4), ("0x" + "0a" * 256, 256)])
def test_fixed_width(spark, text, width):
    value = one(spark, lambda c: codec.hex_to_fixed(c, width), text)
    assert bytes(value) == bytes.fromhex(text[2:]) and one(spark, codec.to_hex, value, "binary") == text
    assert one(spark, lambda c: codec.hex_to_fixed(c, width), text[:-1]) is None
    assert one(spark, lambda c: codec.hex_to_fixed(c, width), text[2:]) is None
    with pytest.raises(Exception, match="bad"):
        one(spark, lambda c: codec.hex_to_fixed(c, width, strict=True), text + "0")


@pytest.mark.parametrize(("text", "value"), [("0x", b""), ("0x0", b"\0"), ("0xabc", b"\x0a\xbc"), ("0x" + "12" * 52, b"\x12" * 52), ("zz", None), (None, None)])
def test_bytes(spark, text, value):
    got = one(spark, codec.hex_to_bytes, text)
    assert (got if got is None else bytes(got)) == value


@pytest.mark.parametrize(
    ("text", "value"),
    [("0xF64B41", 16141121), ("16141121", 16141121), ("0x0", 0), ("0xffffffffffffffff", 2**64 - 1), ("18446744073709551615", 2**64 - 1), ("18446744073709551616", None), ("0x1ffffffffffffffff", None), ("-1", None), ("", None), ("0x", None), ("0x00000000000000000001", 1)],
)
def test_u64(spark, text, value):
    got = one(spark, codec.parse_u64, text)
    assert got == (None if value is None else Decimal(value))
    assert value is None or one(spark, lambda c: codec.render_u64(codec.parse_u64(c)), text) == str(value)


@pytest.mark.parametrize(("text", "value"), [("0xF64B41", 16141121), ("F64B41", 16141121), ("0xffffffff", 2**32 - 1), ("0x100000000", None), ("xyz", None), ("0x000000001f", 31)])
def test_u32(spark, text, value):
    assert one(spark, codec.parse_u32, text) == value
    assert value is None or int(one(spark, lambda c: codec.number_to_hex(codec.parse_u32(c)), text), 16) == value


def test_numbers_as_bytes(spark):
    for n in (0, 1, 255, 256, 2**63 - 1):
        b = one(spark, codec.int_to_bytes, n, "long")
        assert bytes(b) == n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big") and one(spark, codec.bytes_to_u64, b, "binary") == n
    assert one(spark, codec.bytes_to_u64, b"\1" * 9, "binary") is None
    for f in (codec.int_to_bytes, codec.int_to_u64):
        with pytest.raises(Exception, match="negative"):
            one(spark, f, -1, "long")


def test_sighash_and_topics(spark):
    assert [one(spark, codec.sighash, x, "binary") for x in (b"", b"abc")] == [None, None]
    assert bytes(one(spark, codec.sighash, b"abcde", "binary")) == b"abcd"
    df = spark.createDataFrame([([b"a", b"b"],), ([],)], "t array<binary>").select(*codec.topics_split(F.col("t")))
    assert [[x and bytes(x) for x in r] for r in df.collect()] == [[b"a", b"b", None, None], [None] * 4]
    assert len(df.select(codec.topics_array(*map(F.col, df.columns))).first()[0]) == 2


def test_folder_keys():
    assert folder_from_key(folder_key(12345, 123456)) == (12345, 123456) and folder_key(12345, 123456) < folder_key(123456, 1234567)
