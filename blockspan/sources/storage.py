"""The archive on disk: immutable folders of three Parquet tables, and a mutable hot tail.

Layout: ``<root>/cold/<table>/folder=blk<from>-<to>/`` and ``<root>/hot/<table>/bucket=<n>/``.
The folder is a partition column, so a block range prunes whole folders at planning;
inside, transactions are sorted by block, logs by address and first topic, and bloom
filters serve the values that sorting can't cluster.
"""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import heights, overlapping, parse_folders
from ..operators.relations import hot_and_cold, last_wins, sorted_runs
from ..plans.compile import Tables
from ..schema import KEYS, TABLES

#: How each table is ordered on disk, and where values are looked up by hash.
ORDER = {"block": ["number"], "transaction": ["block_number", "transaction_index"], "log": ["address", "topic0"]}
BLOOMS = {"block": [], "transaction": ["source", "dest"], "log": ["address", "topic0"]}
NUMBER = {"block": "number", "transaction": "block_number", "log": "block_number"}
TABLE_NAMES = {"block": "block", "transaction": "tx", "log": "log"}


@dataclass(frozen=True)
class WriteOptions:
    folder_blocks: int = 100_000
    #: A folder also ends where it has so many transactions, or logs.
    folder_rows: int = 1 << 62
    bucket_blocks: int = 1_000
    row_group_bytes: int = 16 << 20
    bloom_false_positives: float = 0.001
    #: lz4_raw pages of some sizes can not be read back by this Spark version.
    compression: str = "zstd"


class Archive:
    """One archive under a path that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str, options: WriteOptions = WriteOptions()):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options

    # -- folders ---------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _children(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _whole(self) -> list[str]:
        """Names of the folders that all three tables have committed, by one listing."""
        fs, p = self._fs(f"{self.root}/cold/*/folder=*/_SUCCESS")
        found = Counter(s.getPath().getParent().getName().removeprefix("folder=") for s in fs.globStatus(p) or [])
        return sorted(n for n, kinds in found.items() if kinds == len(TABLE_NAMES))

    def manifest(self, names: list[str] | None = None) -> DataFrame:
        """Folders that all three tables have whole, one row each."""
        whole = [(n, f"{self.root}/cold/*/folder={n}") for n in (self._whole() if names is None else names)]
        return parse_folders(self.spark.createDataFrame(whole, "name string, path string")).select("from", "to", "is_temp", "path", "name")

    def write_folder(self, first: int, end: int, blocks: DataFrame, transactions: DataFrame, logs: DataFrame) -> None:
        """Write the blocks of [first, end) as one folder. Each table is committed as a
        whole, and the manifest counts only what all three have; a try anew overwrites."""
        frames = {"block": blocks, "transaction": transactions, "log": logs}
        for entity, df in frames.items():
            number = F.col(NUMBER[entity])
            df = sorted_runs(df.where((number >= first) & (number < end)), ORDER[entity])
            writer = df.write.mode("overwrite").option("compression", self.options.compression).option("parquet.block.size", self.options.row_group_bytes)
            for c in BLOOMS[entity]:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.fpp#{c}", self.options.bloom_false_positives)
            writer.parquet(f"{self.root}/cold/{TABLE_NAMES[entity]}/folder=blk{first:09d}-{end:09d}")

    def _within(self, manifest: DataFrame, first: int, end: int | None) -> list[str]:
        """Names of the folders that share blocks with the range."""
        rows = overlapping(manifest, first, (1 << 62) if end is None else end) if end is not None or first else manifest
        return [r["name"] for r in rows.select("name").collect()]  # a name each folder

    def cold(self, entity: str, first: int = 0, end: int | None = None, names: list[str] | None = None) -> DataFrame:
        """Rows of the folders that share blocks with the range, or of the named ones."""
        names = self._within(self.manifest(), first, end) if names is None else names
        schema = TABLES[entity]
        if not names:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/cold/{TABLE_NAMES[entity]}"
        return self.spark.read.schema(schema).parquet(*(f"{base}/folder={n}" for n in names))

    # -- hot tail --------------------------------------------------------------------

    def upsert_hot(self, entity: str, rows: DataFrame) -> None:
        """Rows replace those of the same key. They are appended with a running number, and
        reading takes the newest of a key, so nothing that is being read is overwritten
        and a batch written twice counts once."""
        bucket = F.floor(F.col(NUMBER[entity]) / self.options.bucket_blocks).cast("long")
        rows = rows.select(*TABLES[entity].names, F.lit(time.time_ns()).alias("seq"), bucket.alias("bucket"))
        rows.write.mode("append").partitionBy("bucket").parquet(f"{self.root}/hot/{TABLE_NAMES[entity]}")

    def hot(self, entity: str, first: int = 0) -> DataFrame:
        """Rows of the blocks from ``first`` on; buckets below aren't touched."""
        path = f"{self.root}/hot/{TABLE_NAMES[entity]}"
        if not any(n.startswith("bucket=") for n in self._children(path)):
            return self.spark.createDataFrame([], TABLES[entity])
        rows = self.spark.read.schema(f"{_ddl(entity)}, seq long, bucket long").parquet(path)
        rows = rows.where((F.col("bucket") >= first // self.options.bucket_blocks) & (F.col(NUMBER[entity]) >= first)).drop("bucket")
        return last_wins(rows, KEYS[entity], "seq").drop("seq")

    def evict_hot(self) -> None:
        """Drop hot buckets that the cold folders cover as a whole."""
        height = self.cold_height()
        for kind in TABLE_NAMES.values():
            for name in self._children(f"{self.root}/hot/{kind}"):
                if name.startswith("bucket=") and (int(name[7:]) + 1) * self.options.bucket_blocks <= height:
                    fs, p = self._fs(f"{self.root}/hot/{kind}/{name}")
                    fs.delete(p, True)

    # -- both ------------------------------------------------------------------------

    def heights(self) -> dict[str, int | None]:
        manifest = self.manifest()
        return heights(manifest, self.hot("block", self.cold_height(manifest))).first().asDict()

    def cold_height(self, manifest: DataFrame | None = None) -> int:
        return (self.manifest() if manifest is None else manifest).where("not is_temp").agg(F.coalesce(F.max("to"), F.lit(0))).first()[0]

    def height(self) -> int:
        return self.heights()["height"]

    def tables(self, first: int = 0, end: int | None = None) -> Tables:
        """The three tables over both tiers, parted at the height of the cold one."""
        manifest = self.manifest()
        at, names = self.cold_height(manifest), self._within(manifest, first, end)
        frames = [hot_and_cold(self.cold(e, names=names), self.hot(e, at), NUMBER[e], at) for e in ("block", "transaction", "log")]
        return Tables(*frames)

    def finalise(self, first: int, end: int) -> None:
        """Move the hot blocks of [first, end) into a cold folder."""
        self.write_folder(first, end, *(self.hot(e, first) for e in ("block", "transaction", "log")))
        self.evict_hot()


def _ddl(entity: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[entity])

