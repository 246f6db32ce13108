"""Processed data stored under a name derived from the settings that made it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def settings_digest(settings: dict, length: int = 16) -> str:
    """The first hex digits of the SHA-256 of the settings in a fixed order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:length]


def cached(spark: SparkSession, root: str, name: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored result for these settings, or ``make()`` stored first.

    A folder counts only once its job has committed (``_SUCCESS``), so a lost driver leaves nothing
    that would be taken for a complete result.
    """
    path = f"{root.rstrip('/')}/{name}_{settings_digest(settings)}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
