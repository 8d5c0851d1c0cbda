"""Sinks: result files, guarded tables, write-once archives."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]{0,63}$")


def save_result(df: DataFrame, path: str, name: str) -> None:
    """The same result as parquet (for jobs) and CSV (for people)."""
    if not NAME.match(name):
        raise ValueError(f"bad result name {name!r}")
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")


def guard(name: str, columns: list[str], prefix: str = "lonja_") -> None:
    """Only own-prefix table names and plain column names pass."""
    if not (NAME.match(name) and name.startswith(prefix)):
        raise ValueError(f"table {name!r} must start with {prefix!r}")
    bad = [c for c in columns if not NAME.match(c)]
    if bad:
        raise ValueError(f"bad column names {bad}")


def save_table(df: DataFrame, name: str, mode: str = "overwrite", prefix: str = "lonja_") -> None:
    """Replace or append a catalogue table; only own-prefix names and plain column names pass."""
    guard(name, df.columns, prefix)
    if mode not in ("overwrite", "append"):
        raise ValueError(mode)
    df.write.mode(mode).format("parquet").saveAsTable(name)


def archive_once(df: DataFrame, path: str, stamp: str, on_exists: str = "error") -> bool:
    """Write a frozen archive for ``stamp``; refuse or skip when it exists. True if written."""
    spark: SparkSession = df.sparkSession
    if not re.match(r"^[0-9A-Za-z_-]+$", stamp):
        raise ValueError(f"bad stamp {stamp!r}")
    out = f"{path}/sello={stamp}"
    try:
        (df.withColumn("archivado", F.current_timestamp())
           .write.mode("errorifexists").parquet(out))
        return True
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e) or on_exists == "error":
            raise
        return False


def write_month_partitions(df: DataFrame, path: str, fecha: str = "fecha") -> None:
    """Replace only the months present in ``df`` (late or corrected documents)."""
    (df.withColumn("anio", F.year(fecha)).withColumn("mes", F.month(fecha))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("anio", "mes").parquet(path))
