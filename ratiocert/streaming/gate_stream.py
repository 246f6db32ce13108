"""The gate over arriving scored responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.gate import judged_draw
from ..session import scratch_path


def scored_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
                  files_per_batch: int | None = None) -> DataFrame:
    """Parquet files with scored responses as they appear in a folder, or those among them whose names fit the pattern."""
    reader = spark.readStream.schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def gate_stream(responses: DataFrame, k: float) -> DataFrame:
    """Every response with its decision; stateless, one draw per request, the batch gate's own test."""
    return responses.select("*", *judged_draw(k, 1)).withColumn("abstained", ~F.col("accepted"))


def abstention_by(decisions: DataFrame, key: str = "dataset") -> DataFrame:
    """Running totals per key: the state is one row per key."""
    return decisions.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("abstained").cast("long")).alias("n_abstained"),
        F.avg(F.col("abstained").cast("double")).alias("share_abstained"),
    )


def drain(aggregated: DataFrame, name: str) -> DataFrame:
    """Runs a keyed running total over everything available and returns the final totals.

    Each batch writes its totals into the shared folder; the last one's are read back.
    """
    spark = aggregated.sparkSession
    path, last = scratch_path(spark, f"totals-{name}"), []

    def store(totals: DataFrame, batch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        last[:] = [batch]

    query = (
        aggregated.writeStream.outputMode("complete").queryName(name).foreachBatch(store)
        .option("checkpointLocation", scratch_path(spark, f"stream-{name}"))
        .trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not last:
        return spark.createDataFrame([], aggregated.schema)
    return spark.read.schema(aggregated.schema).parquet(f"{path}/batch={last[0]}")
