"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word definition: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Stands for a NULL id, which comes last.
NULL_ID = (1 << 63) - 1

#: Rows of one Arrow batch. Documents average a few kB, so a batch stays in the tens of MB.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def prepare(spark: SparkSession) -> None:
    """Session set-up of the corpus operators: Python batches are kept small because texts
    can be long, and executors get this package from the driver once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_pourstat_shipped", None) is None:
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        target = os.path.join(tempfile.mkdtemp(prefix="pourstat-code-"), "pourstat")
        sc.addPyFile(shutil.make_archive(target, "zip", top, "pourstat"))
        sc._pourstat_shipped = target
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def settled(df: DataFrame, name: str) -> DataFrame:
    """The same rows; a filter on column ``name`` is then applied to its finished value.

    Without it the optimiser moves the filter below the projections and evaluates their
    expressions anew inside every lambda that refers to them. A generator stops that.
    """
    return df.withColumn(name, F.explode_outer(F.array(f"`{name}`")))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    """A partition count that grows with the rows, so that the size of a partition does not."""
    return max(least, math.ceil(rows / per_partition))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that all executors share.

    ``spark.checkpoint.dir`` is read from the session. Without it a folder is chosen only
    for a local master, as in tests; a cluster must name a shared one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is not None:
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pourstat-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names."""
    sc, folder = df.sparkSession.sparkContext, checkpoint_dir(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Written to the shared folder and read back, so lineage and shuffles end here."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def identified(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Adds ``doc`` (NULL ids last) and ``th``, a hash of the text where an id is repeated and 0 elsewhere."""
    doc = F.coalesce(F.col(f"`{ident}`").cast("long"), F.lit(NULL_ID))
    rows = df.select(F.col(f"`{ident}`").alias("doc_id"), doc.alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    repeated = rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc", F.lit(True).alias("again"))
    if repeated.isEmpty():
        return rows.withColumn("th", F.lit(0).cast("long"))
    return rows.join(repeated, "doc", "left").withColumn(
        "th", F.when(F.col("again"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0))
    ).select("doc_id", "doc", "text", "th")
