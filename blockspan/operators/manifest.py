"""The manifest of an archive: a row ``from, to, is_temp, path`` for each folder.

Folders hold half-open block ranges and are named after them. A manifest has a row for
each folder, not for each block, so what is ordered as a whole here is small.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAME = r"^blk([0-9]{9,})-([0-9]{9,})(temp)?$"
#: The files of a complete folder.
FILES = ("block", "tx", "log")


def folder_name(first: Column, end: Column) -> Column:
    return F.format_string("blk%09d-%09d", first.cast("long"), end.cast("long"))


def parse_folders(df: DataFrame, name: str = "name") -> DataFrame:
    """``df`` with ``from``, ``to`` and ``is_temp``; names of other kinds are left out."""
    n = F.col(name)
    parsed = df.where(n.rlike(NAME))
    bounds = [F.regexp_extract(n, NAME, i).cast("long") for i in (1, 2)]
    return parsed.select("*", bounds[0].alias("from"), bounds[1].alias("to"), (F.regexp_extract(n, NAME, 3) == "temp").alias("is_temp"))


def folder_key(first: int, end: int) -> bytes:
    """Eight bytes that sort as (first, end) does."""
    return struct.pack(">II", first, end)


def folder_from_key(key: bytes) -> tuple[int, int]:
    return struct.unpack(">II", key)


def parse_object_key(df: DataFrame, key: str = "key") -> DataFrame:
    """From object keys ``folder/file.parquet`` to folder ranges and the file's kind."""
    parts = F.split(F.col(key), "/")
    split = df.select("*", F.get(parts, F.size(parts) - 2).alias("name"), F.regexp_extract(F.element_at(parts, -1), r"^(\w+)\.parquet$", 1).alias("file"))
    return parse_folders(split)


def overlapping(manifest: DataFrame, first: int, end: int) -> DataFrame:
    """Folders that share blocks with [first, end), and the part they share."""
    hit = manifest.where(~F.col("is_temp") & (F.col("from") < end) & (F.col("to") > first))
    return hit.select("*", F.greatest("from", F.lit(first)).alias("clip_from"), F.least("to", F.lit(end)).alias("clip_to"))


def _ordered(manifest: DataFrame) -> DataFrame:
    order = Window.orderBy("from")
    whole = manifest.where(~F.col("is_temp")).select("from", "to")
    return whole.withColumn("prev_to", F.lag("to").over(order)).withColumn("gap", F.coalesce((F.col("prev_to") != F.col("from")).cast("int"), F.lit(0)))


def resume_block(manifest: DataFrame) -> DataFrame:
    """One row, ``start_block``: the end of the run of folders without a gap, from block 0.

    0 for an empty manifest. A first folder that doesn't begin at 0 is an error.
    """
    rows = _ordered(manifest)
    cut = rows.agg(F.min(F.when(F.col("gap") == 1, F.col("prev_to"))).alias("gap_at"), F.max("to").alias("end"), F.min("from").alias("first"))
    bad = F.raise_error(F.concat(F.lit("the first folder begins at "), F.col("first").cast("string"))).cast("long")
    return cut.select(F.when(F.col("first").isNull(), 0).when(F.col("first") != 0, bad).otherwise(F.coalesce("gap_at", "end")).cast("long").alias("start_block"))


def contiguous_run(manifest: DataFrame, first: int) -> DataFrame:
    """Folders from the one that begins at ``first`` on, as far as each begins where the
    one before ends; none if no folder begins there."""
    rows = _ordered(manifest.where(F.col("from") >= first))
    order = Window.orderBy("from").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("broken", F.max("gap").over(order)).withColumn("head", F.min("from").over(order))
    return runs.where((F.col("broken") == 0) & (F.col("head") == first)).select("from", "to")


def gaps(manifest: DataFrame) -> DataFrame:
    """Missing ranges between folders."""
    return _ordered(manifest).where("gap = 1").select(F.col("prev_to").alias("from"), F.col("from").alias("to"))


def complete_folders(files: DataFrame, start: int = 0) -> DataFrame:
    """Folders of which all files are there and that end behind ``start``."""
    known = files.where(F.col("file").isin(*FILES) & ~F.col("is_temp") & (F.col("to") > start))
    return known.groupBy("from", "to").agg(F.countDistinct("file").alias("n_files")).where(F.col("n_files") == len(FILES)).select("from", "to")


def hull(ranges: DataFrame) -> DataFrame:
    """The least range that holds all."""
    return ranges.agg(F.min("from").alias("from"), F.max("to").alias("to"))


def missing_files(have: DataFrame, want: DataFrame, key: str = "key") -> DataFrame:
    """Listed in ``want`` and not in ``have``: what a sync has still to copy."""
    return want.select(key).distinct().join(have.select(key), key, "left_anti")


def heights(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """One row: ``parquet_height`` (end of the cold folders), ``db_tail`` and ``db_height``
    (first and behind the last hot block), ``height`` (behind the last block without a gap
    between the two).

    Hot rows count only if they begin at or below the cold end; without hot rows the cold
    end is the height.
    """
    c = cold.where(~F.col("is_temp")).agg(F.coalesce(F.max("to"), F.lit(0)).alias("parquet_height"))
    h = hot.agg(F.min("number").alias("db_tail"), (F.max("number") + 1).alias("db_height"))
    joined = F.col("db_tail").isNotNull() & (F.col("db_tail") <= F.col("parquet_height"))
    height = F.when(joined, F.greatest("db_height", "parquet_height")).otherwise(F.col("parquet_height"))
    return c.join(h, F.lit(True)).select("parquet_height", "db_tail", "db_height", height.alias("height"))


def column_ranges(df: DataFrame, by: list, *columns: str) -> DataFrame:
    """Least and greatest value and the number of distinct ones, for each group of rows."""
    found = [x for c in columns for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.countDistinct(c).alias(f"n_{c}"))]
    return df.groupBy(*by).agg(*found)
