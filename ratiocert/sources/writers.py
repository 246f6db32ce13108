"""Writing scores, tables, result files and corpora."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import checked_broadcast
from ..operators.ordering import row_positions
from ..session import cut_lineage
from .readers import file_sizes


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, sep="\t", header=True)


def write_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    df.select(*columns).write.mode("errorifexists").csv(path, header=True)


def write_scores(df: DataFrame, path: str, by: str = "run_id") -> None:
    """Parquet, one folder per run, so that reading one run prunes the rest."""
    df.write.mode("errorifexists").partitionBy(by).parquet(path)


def write_results(results: DataFrame, metrics: DataFrame, config: dict[str, str], path: str) -> None:
    """Config, results and metrics side by side: results stay a distributed table of JSON lines."""
    results.write.mode("errorifexists").json(f"{path}/results")
    spark = results.sparkSession
    settings = spark.createDataFrame([(k, str(v)) for k, v in config.items()], "name string, value string")
    settings.coalesce(1).write.mode("errorifexists").json(f"{path}/config")
    metrics.coalesce(1).write.mode("errorifexists").json(f"{path}/metrics")


def write_splits(pairs: DataFrame, path: str, order: str) -> None:
    """A JSON table per split, and all pairs joined as text lines in id order.

    The pairs are stored first: both outputs, and the look at the ids before they are ordered, would each make them again.
    """
    pairs = cut_lineage(pairs.select(order, "split", "input", "answer"))
    pairs.select("split", "input", "answer").write.mode("errorifexists").partitionBy("split").json(f"{path}/splits")
    lines = pairs.orderBy(order).select(F.concat_ws(" ", "input", "answer").alias("value"))
    lines.write.mode("errorifexists").text(f"{path}/all_text")


MANIFEST_TASKS = 1000  # a file is one task's work; beyond so many files they share tasks
# Files with these endings are unpacked by the text source, so their bytes are read whole.
PACKED_ENDS = ("gz", "bz2", "zst", "lz4", "snappy", "deflate")
PACKED = rf"\.({'|'.join(PACKED_ENDS)})$"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, bytes, md5) of every file below a folder, as ``md5sum`` gives them, for files of any size.

    A digest takes a file's bytes in order, so a file is one task's work. They arrive there as lines, sorted by their place
    in the file, and only a batch of them is held. Files are dealt out by their place in the order of their sizes, so that no two
    meet in a task by chance. Packed files alone are taken whole, up to the 2 GB that Spark allows them.
    """
    files = file_sizes(spark, path)
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*").option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
    ).where(~F.col("path").rlike(PACKED))
    listed = cut_lineage(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")))
    tasks = min(max(listed.count(), 1), MANIFEST_TASKS)
    dealt = row_positions(listed, ["size", "path"], "spot").select("path", (F.col("spot") % tasks).cast("int").alias("task"))
    placed = lines.join(checked_broadcast(dealt), "path").repartitionById(tasks, F.col("task"))
    digests = placed.sortWithinPartitions("path", "block", "row").mapInArrow(_digests, "path string, bytes long, md5 string")
    # By name, since a filter of rows would come after their contents were read, those of all files.
    packed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", f"*.{{{','.join(PACKED_ENDS)}}}").load(path).where(F.col("path").rlike(PACKED))
    whole = packed.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"))
    empty = files.where((F.col("bytes") == 0) & ~F.col("path").rlike(PACKED)).select("path", "bytes", F.md5(F.lit("")).alias("md5"))
    found = digests.unionByName(whole).unionByName(empty)
    return found.select("path", F.regexp_replace("path", "^.*/", "").alias("file"), "bytes", "md5")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a file from its lines in order. Between lines stands a line end; after the last one if the file's size says so."""
    path, size, seen, digest = None, 0, 0, hashlib.md5()

    def done() -> pa.RecordBatch:
        if seen < size:
            digest.update(b"\n")
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], names=["path", "bytes", "md5"])

    for batch in batches:
        for line, here, n in zip(batch.column("line"), batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            if here != path:
                if path is not None:
                    yield done()
                path, size, seen, digest = here, n, 0, hashlib.md5()
            else:
                digest.update(b"\n")
                seen += 1
            held = line.as_buffer()
            digest.update(held)
            seen += held.size
    if path is not None:
        yield done()
