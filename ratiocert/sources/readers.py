"""Reading score runs, result files, corpora, text and tables."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.ordering import first_in_order, row_positions


def score_runs(spark: SparkSession, root: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """All score runs below one or more folders (``run_id=...`` folders), stacked by column name.

    A file that can't be read fails the job; :func:`readable_runs` leaves it out.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    return reader.parquet(*([root] if isinstance(root, str) else list(root)))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def file_sizes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, bytes) of every file below; contents are not read.

    A scan passes empty files by, so the names come from the listing that the scan is made from and the driver has anyway.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([paths] if isinstance(paths, str) else list(paths))
    names = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string")
    sizes = files.select(_bare(F.col("path")).alias("__bare"), F.col("length").alias("bytes"))
    return names.withColumn("__bare", _bare(F.col("path"))).join(sizes, "__bare", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def readable_runs(spark: SparkSession, folders: Sequence[str]) -> tuple[DataFrame | None, DataFrame]:
    """The rows of all files that can be read, stacked by column name with their ``folder``, and (path, bytes) of the other files.

    A damaged file costs only itself; a folder that does not exist counts as one such file, without bytes. Columns are those of
    any readable file. All folders take the same jobs together: their footers are read by one, and files that give no
    row, damaged or empty, are found by a count that reads no column.
    """
    there = [f for f in folders if _exists(spark, f)]
    missing = spark.createDataFrame([(f, None) for f in folders if f not in set(there)], "path string, bytes long")
    if not there:
        return None, missing
    listed = file_sizes(spark, there)
    try:
        found = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(*there)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None, missing.unionByName(listed)
    place = F.col("_metadata.file_path")
    seen = found.groupBy(_bare(place).alias("__seen")).agg(F.count("*").alias("n")).select("__seen")
    unread = listed.join(seen, _bare(F.col("path")) == F.col("__seen"), "left_anti")
    return found.withColumn("folder", F.regexp_replace(place, "/[^/]*$", "")), missing.unionByName(unread)


def _bare(path: Column) -> Column:
    """A file's place without the slashes after the scheme, which Spark's sources write in different numbers."""
    return F.regexp_replace(path, "^([a-z0-9]+:)/+", "$1/")


def gate_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(idx, result fields) of every document {"config", "results", "metrics"}.

    By default a file is one JSON document and so one row; without ``multi_line`` a file holds one
    document per line, which is the form for large results.
    """
    files = spark.read.schema(schemas.GATE_RESULTS_FILE).json(path, multiLine=multi_line)
    return files.select(F.posexplode("results").alias("idx", "r")).select("idx", "r.*")


def qa_corpus(spark: SparkSession, path: str, schema: T.StructType = schemas.QA_CORPUS, fmt: str = "json",
              renames: dict[str, str] | None = None) -> DataFrame:
    """A question-answer corpus with a declared schema; ``renames`` maps stored to canonical names."""
    df = spark.read.schema(schema).format(fmt).load(path)
    return df.withColumnsRenamed(renames or {})


QA_SHAPES = ("extract", "judged", "choices")


def qa_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Question-answer corpora of differing schema, read together: (shape, id, subject, question, contexts, answers, choices, answer_idx, decision).

    Every document is taken as a variant value, and its shape is seen from the paths it has:
    ``extract`` has one context and a list of answers (``answers.text``), ``judged`` a list of contexts (``context.contexts``), a long
    answer and a decision, ``choices`` a list of choices and the number of the right one, which is also its answer. The subject is found
    under ``task``, ``subject`` or ``title``. What a shape does not have is null; lists are empty instead.
    """
    v = F.col("v")
    docs = spark.read.format("json").option("singleVariantColumn", "v").load([paths] if isinstance(paths, str) else list(paths))

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(v, path, kind)

    none = F.array().cast("array<string>")
    choices, several = at("$.choices", "array<string>"), at("$.context.contexts", "array<string>")
    shape = F.when(choices.isNotNull(), "choices").when(several.isNotNull(), "judged").otherwise("extract")
    parts = docs.select(
        shape.alias("shape"), at("$.id").alias("id"), F.coalesce(at("$.task"), at("$.subject"), at("$.title")).alias("subject"),
        at("$.question").alias("question"), F.coalesce(several, F.filter(F.array(at("$.context")), lambda c: c.isNotNull())).alias("contexts"),
        F.coalesce(at("$.answers.text", "array<string>"), F.filter(F.array(at("$.long_answer")), lambda a: a.isNotNull())).alias("answers"),
        F.coalesce(choices, none).alias("choices"), at("$.answer", "int").alias("answer_idx"), at("$.final_decision").alias("decision"),
    )
    right = F.filter(F.array(F.try_element_at("choices", F.col("answer_idx") + 1)), lambda c: c.isNotNull())
    return parts.withColumn("answers", F.when(F.col("shape") == "choices", right).otherwise(F.col("answers")))


def prompt_responses(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(idx, prompt, response) of documents {"data": [{prompt, response}]}."""
    files = spark.read.schema(schemas.PROMPT_RESPONSE_FILE).json(path, multiLine=multi_line)
    return files.select(F.posexplode("data").alias("idx", "p")).select("idx", "p.*")


def file_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with columns (file, block, row) that sort them in file order."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def text_lines(spark: SparkSession, path: str, chars: int, n: int) -> DataFrame:
    """The first ``n`` lines in file order (all where negative), stripped and cut to ``chars`` characters."""
    lines = file_ordered(spark, path)
    first = first_in_order(lines, ["file", "block", "row"], n) if n >= 0 else lines
    return first.select(F.substring(stripped(F.col("value")), 1, chars).alias("line"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def category_list(spark: SparkSession, folder: str, name: str = "categories.txt") -> DataFrame:
    """(category, idx) from the folder's own list, or from its parent's."""
    for place in (folder, posixpath.dirname(folder.rstrip("/"))):
        path = posixpath.join(place, name)
        if _exists(spark, path):
            lines = file_ordered(spark, path).where(F.trim("value") != "")
            placed = row_positions(lines, ["file", "block", "row"])
            return placed.select(F.trim("value").alias("category"), "idx")
    raise FileNotFoundError(f"{name} is neither in {folder} nor in its parent")


def eps_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated k/epsilon table; older column names are accepted. Adds ``k``."""
    table = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    table = table.withColumnsRenamed({o: n for o, n in schemas.EPS_TABLE_OLD_NAMES.items() if n not in table.columns})
    typed = table.select(*[F.col(f.name).cast(f.dataType) for f in schemas.EPS_TABLE.fields])
    return typed.withColumn("k", F.col("k_mid"))
