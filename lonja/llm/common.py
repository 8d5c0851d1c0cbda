"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lonja.session import shared_dir

#: ASCII letters to lower case; ASCII characters that belong to no word to spaces.
WORD_TABLE = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def word_bytes(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(doc_id: Column, text: Column) -> Column:
    """The doc_id; rows without one get a negative number made from their text."""
    return F.coalesce(doc_id.cast("long"), -F.abs(F.xxhash64(text)) - F.lit(1))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, heavy: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row per ``keys`` and the number of its rows in ``size``.

    Groups with more than one ``heavy``-th of all rows (fewer than ``heavy`` of them, whatever the table) are broadcast;
    the rows of the others are joined by a shuffle in which no key weighs much.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    big = F.broadcast(groups.filter(F.col(size) * heavy > total))
    return rows.join(big, keys).unionByName(rows.join(big, keys, "left_anti").join(groups.filter(F.col(size) * heavy <= total), keys))
