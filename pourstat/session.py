"""Session set-up shared by applications, tests and the benchmark."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. Shuffle partition counts and memory are
# left to the cluster; AQE coalesces small partitions and splits skewed ones.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on a hot key is split even when the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Generated code of very wide rows exceeds the size the JIT compiles by default; on a
# cluster the same option belongs in spark.executor.extraJavaOptions.
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "pourstat", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.extraJavaOptions", JVM_OPTIONS)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, set on the context.

    It comes from ``spark.checkpoint.dir``. Where the session names none, a temporary folder
    is set for a local master only; a cluster must name a shared one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pourstat-ckpt-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by writing Parquet below the checkpoint folder and reading it back.

    Later passes read only the columns they use, and a short table is known to be short when
    joins are planned. Columns must have types and names that Parquet takes.
    """
    path = os.path.join(checkpoint_folder(df.sparkSession), f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(df: DataFrame) -> DataFrame:
    """Keep a result on the executors because several branches of one job read it.

    Blocks spill to disk, and a lost block is recomputed from its lineage.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for jobs that run Python there."""
    sc = spark.sparkContext
    if getattr(sc, "_pourstat_shipped", None) is None:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="pourstat-code-"), "pourstat")
        sc.addPyFile(shutil.make_archive(target, "zip", top, "pourstat"))
        sc._pourstat_shipped = target
