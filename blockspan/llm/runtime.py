"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent (a local session, as in tests) a temporary folder
    is used, which is then also the checkpoint folder of the session.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, stored in the shared folder, lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """``keep`` for loops. A checkpoint hands on Spark's estimate of its size, that of a join
    is the product of its sides', and so it squares from round to round until the planner
    itself takes minutes over its digits. Here the rows become a table of unknown size.

    Spark deletes shuffle files (and, where set so, checkpoints) that nothing refers to any
    more once the driver's garbage is collected, which by itself can come long after many
    rounds; here it is asked for, so that disk holds a round and not all of them."""
    spark, kept = df.sparkSession, keep(df)
    gc.collect()
    spark._jvm.System.gc()
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), spark)


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df: DataFrame, text_col: str, each: int = 64 << 20) -> int:
    """As many tasks as give each so many bytes of text; the session's number at least."""
    size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(n_tasks(df.sparkSession), -(-size // each))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; resolved on whatever machine calls it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def single_threaded_tokenizers() -> None:
    """A Spark task owns one core; the library's own threads would take others' cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
