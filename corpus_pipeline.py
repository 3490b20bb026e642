"""A training corpus from raw documents: five stages, each an operator of blockspan.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all
but the last return the columns of ``docs``. ``run`` writes each result as Parquet in the
shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockspan.llm.decontamination import decontaminate
from blockspan.llm.line_dedup import line_dedup
from blockspan.llm.near_dedup import near_duplicates
from blockspan.llm.packing import pack
from blockspan.llm.quality import quality_model, score
from blockspan.llm.runtime import new_path, read


def _hidden(docs: DataFrame) -> DataFrame:
    """``docs`` with names for all but id and text that no operator uses itself."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"column {i}" for i, c in enumerate(docs.columns)))


def _shown(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, by their own names again."""
    return df.select(*(F.col(c if c in ("doc_id", "text") else f"column {i}") for i, c in enumerate(docs.columns))).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier calls good. It learns from labels of ``docs``."""
    model = quality_model(docs, read(spark, sf_dir, "labels"))
    return _shown(score(_hidden(docs), model).where("predicted = 1"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five or more documents hold; the last one keeps them.

    ``n_chars``, where there is one, is that of the new text. Documents that lose all their
    lines stay, empty.
    """
    kept = _shown(line_dedup(_hidden(docs)), docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id; of rows with the
    same id and text one.

    Documents without an id stay, since no class can name them; of equal texts one.
    """
    first = near_duplicates(docs.select("doc_id", "text")).where("doc_id = class_id").select("doc_id").distinct()
    rows = _hidden(docs).withColumn("print", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("is_null", F.col("text").isNull())
    # The join has dealt the rows by id already; the rows of an id are told apart where they are.
    named = rows.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "print", "is_null"])
    nameless = rows.where("doc_id is null").dropDuplicates(["print", "is_null"])
    return _shown(named.unionByName(nameless), docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmarks", benchmarks), ("packing", packing)]

#: SQL can express neither the classifier nor the sketches; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
