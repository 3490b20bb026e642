"""Older archives: the same tables in earlier Parquet formats.

Format ``0.0.39`` has several columns as signed 64-bit integers and no transaction status;
``0.1.0`` has today's types. Both lie in folders ``blk<from>-<to>`` of three files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.codec import int_to_bytes, int_to_u64, sighash
from ..operators.manifest import complete_folders, folder_name, gaps, parse_folders
from ..schema import BLOCKS, LOGS, TABLES, TRANSACTIONS

#: Columns of format 0.0.39 that are int64 there.
INT64 = {"block": ("timestamp", "size"), "transaction": ("gas", "gas_price", "max_fee_per_gas", "max_priority_fee_per_gas", "v"), "log": ()}
FILES = {"block": "block", "transaction": "tx", "log": "log"}
VERSIONS = ("0.0.39", "0.1.0")


def source_schema(entity: str, version: str) -> StructType:
    """What the files of a version hold, of today's columns."""
    if version not in VERSIONS:
        raise ValueError(f"unknown format {version}; known are {', '.join(VERSIONS)}")
    old = version == "0.0.39"
    drop = {"sighash"} | ({"status"} if old else set())
    return StructType([StructField(f.name, LongType() if old and f.name in INT64[entity] else f.dataType) for f in TABLES[entity] if f.name not in drop])


def adapt(df: DataFrame, entity: str, version: str) -> DataFrame:
    """Rows of a version as rows of today; negative numbers are an error, and so is a
    missing type or gas price in the older format."""
    old = version == "0.0.39"
    columns = []
    for f in {"block": BLOCKS, "transaction": TRANSACTIONS, "log": LOGS}[entity]:
        c = F.col(f.name)
        if old and f.name in INT64[entity]:
            c = int_to_u64(c) if f.name == "v" else int_to_bytes(c)
        if old and f.name in ("kind", "gas_price") and entity == "transaction":
            c = F.coalesce(c, F.raise_error(F.lit(f"{f.name} is missing")).cast(f.dataType))
        if f.name == "sighash":
            c = sighash(F.col("input"))
        if old and f.name == "status":
            c = F.lit(None)
        columns.append(c.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def folders(spark: SparkSession, root: str, start: int = 0) -> DataFrame:
    """``from, to, is_temp`` of the folders under a root that have all their files and end
    behind ``start``. The listing is Hadoop's, so any of its file systems will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/blk*/*.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    rows = [(f.getPath().getParent().getName(), f.getPath().getName().removesuffix(".parquet")) for f in found]
    files = parse_folders(spark.createDataFrame(rows, "name string, file string"))
    return complete_folders(files, start).withColumn("is_temp", F.lit(False))


def read_folders(spark: SparkSession, root: str, entity: str, version: str, start: int = 0) -> DataFrame:
    """Rows from block ``start`` on of the complete folders of an older archive.

    A range that is missing between two folders is an error, as rows would be lost.
    """
    found = folders(spark, root, start)
    if missing := gaps(found).orderBy("from").first():
        raise ValueError(f"blocks {missing['from']} to {missing['to'] - 1} are missing")
    names = [r[0] for r in found.select(folder_name(F.col("from"), F.col("to"))).collect()]
    schema = source_schema(entity, version)
    paths = [f"{root.rstrip('/')}/{n}/{FILES[entity]}.parquet" for n in names]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    number = "number" if entity == "block" else "block_number"
    return adapt(rows.where(F.col(number) >= start), entity, version)


def stream_folders(spark: SparkSession, root: str, entity: str, version: str, files_per_trigger: int = 8) -> DataFrame:
    """The same as a stream that takes in new folders as they appear."""
    path = f"{root.rstrip('/')}/blk*[0-9]/{FILES[entity]}.parquet"
    rows = spark.readStream.schema(source_schema(entity, version)).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return adapt(rows, entity, version)


def folder_files(spark: SparkSession, root: str) -> DataFrame:
    """``key`` of every file, for completeness checks and syncs; listed by Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root)
    return files.select(F.col("path").alias("key"))
