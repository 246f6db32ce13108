"""What the modules of this subpackage share: registration, stored steps, seeded numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def reach_sql(edges: str, nodes: str) -> str:
    """Subqueries ``both`` and ``reach`` (id, other): all that links (a, b) lead to; for the SQL of small tables."""
    return (f"both_ways AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}), "
            f"reach(id, other) AS (SELECT id, id FROM {nodes} UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a)")


SMALL_BATCH = "2m"  # for operators that gain nothing from more rows at a time


def bounded(spark: SparkSession, batch: str = "8m") -> None:
    """Session settings that bound what a task and a job hold: Arrow batches of at most ``batch``, however long the texts,
    and no shuffle files beyond the job that wrote them (what later jobs read is stored)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


class Shelf:
    """Stored steps of one operator, whose files go once no later step reads them."""

    def __init__(self):
        self.places: dict[int, tuple[DataFrame, list[str]]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        stored = cut_lineage(df)
        self.places[id(stored)] = stored, sorted({f.rsplit("/", 1)[0] for f in stored.inputFiles()})
        return stored

    def keep_all(self, parts: Iterable[DataFrame]) -> DataFrame:
        """Rows of all parts as one stored table, each part written before the next one is made."""
        path, part = None, None
        for part in parts:
            path = path or scratch_path(part.sparkSession, "stored")
            part.write.mode("append").parquet(path)
        stored = part.sparkSession.read.schema(part.schema).parquet(path)
        self.places[id(stored)] = stored, [path]
        return stored

    def drop_all(self) -> None:
        self.drop(*[df for df, _ in self.places.values()])

    def drop(self, *stored: DataFrame | None) -> None:
        """Removes the files of tables kept here; others are left as they are."""
        for df in stored:
            held, places = self.places.pop(id(df), (None, []))
            if held is None:
                continue
            jvm, conf = held.sparkSession._jvm, held.sparkSession._jsc.hadoopConfiguration()
            for place in places:
                path = jvm.org.apache.hadoop.fs.Path(place)
                path.getFileSystem(conf).delete(path, True)


def unit_number(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the values alone, so that retries and reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(2**53))


def sampled(df: DataFrame, total: int, most: int, *key: str) -> DataFrame:
    """About ``most`` of ``total`` rows: those whose digest of ``key`` is small. No row leaves its task for this."""
    rate = most / max(total, 1)
    return df if rate >= 1 else df.where(unit_number(F.lit("sample"), *key) < rate)


def bounded_sample(df: DataFrame, total: int, most: int, *key: str) -> DataFrame:
    """As ``sampled``, in the order of the digests and never more than ``most`` rows: few more reach the one task that cuts."""
    some = sampled(df, total, most + 4 * int(most**0.5) + 4, *key)
    return some.orderBy(unit_number(F.lit("sample"), *key), *key).limit(most)


def word_count(text: str | Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
