"""Staged tables: results that several later steps read again.

A staged table is written once per application as parquet under the shared folder named by
``spark.checkpoint.dir`` and read back as a plain scan. That keeps plans short, gives the
optimizer real statistics and column pruning, and survives the loss of any executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lonja.session import shared_dir

_STAGED: dict[tuple[str, str, str], tuple[str, object]] = {}


def staged(spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame], file_rows: int = 0) -> DataFrame:
    """The table ``name`` of ``scope``; with ``file_rows``, in files of at most so many rows."""
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _STAGED:
        df = build()
        path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}/{name}"
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
        _STAGED[key] = (path, df.schema)
    path, schema = _STAGED[key]
    return spark.read.schema(schema).parquet(path)


def frozen(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into a new folder, and read back: smaller than a checkpoint, and columns can be pruned."""
    path = f"{shared_dir(df.sparkSession)}/staged/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Stage everything anew from here on (inputs changed, or a timing must start cold)."""
    _STAGED.clear()
