"""Session helpers: local session for tests, the shared folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks. On a cluster use the session it gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ratiocert")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster an unset
    folder is an error, because files on one machine would be lost with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not configured and current.isDefined():
        return current.get()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="ratiocert-")
    if not current.isDefined():
        context.setCheckpointDir(configured)
    return current.get() if current.isDefined() else configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    A lost executor then costs no recomputation of what came before. As a table it keeps column
    pruning, and its size on disk lets the optimiser decide about broadcasting it.
    """
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for files a job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread_rows(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` in parts of about ``rows`` rows, at least one a core, so that no task grows with the table.

    For narrow rows, such as ids, from which much is computed: all of them move.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files split into fewer parts than that.

    For costly work per row on a few large row groups. Inputs with enough parts stay as they are,
    without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
