"""Files as they come: months whose column types drift, and feeds that can't be read.

Every file is looked at once, in tasks: the footer of a parquet file, or the whole of a compressed feed in
pieces. Files of equal footers are one scan; scans are cast to the asked schema and united. A file that
can't be read is named with the reason and left out whole; a file of no bytes holds nothing and isn't named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lonja.session import cut_lineage

PIECE = 1 << 20


def _opened(path: str):
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner


def footer_of(path: str) -> str:
    """Names and types of a parquet file, in order."""
    import pyarrow.parquet as pq
    store, inner = _opened(path)
    with store.open_input_file(inner) as f:
        return ", ".join(f"{c.name} {c.type}" for c in pq.read_schema(f))


def readable_feed(path: str) -> str:
    """Read a feed to its end, unpacked, holding one piece at a time."""
    import pyarrow as pa
    store, inner = _opened(path)
    packing = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}.get(path.rsplit(".", 1)[-1])
    with store.open_input_stream(inner, compression=None) as f, (pa.CompressedInputStream(f, packing) if packing else f) as text:
        while text.read(PIECE):
            pass
    return ""


def inspected(spark: SparkSession, path: str, look: Callable[[str], str]) -> DataFrame:
    """path, found, reason (null if it can be read) of every file below ``path``; contents stay where they are."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["path"]:
                try:
                    out.append((p, look(p), None))
                except Exception as e:  # whatever is wrong with the file is its reason
                    out.append((p, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["path", "found", "reason"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return cut_lineage(files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "path string, found string, reason string"))


def read_drifting(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of all readable parquet files in the asked schema, and (path, reason) of the others.

    An absent column and a value that doesn't fit its type are null.
    """
    seen = inspected(spark, path, footer_of)
    groups = seen.where("reason is null").groupBy("found").agg(F.collect_list("path").alias("paths")).collect()  # names of files only
    parts = []
    for g in groups:
        df = spark.read.parquet(*g["paths"])
        parts.append(df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]))
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return rows, seen.where("reason is not null").select("path", "reason")


def read_feeds(spark: SparkSession, path: str, schema: T.StructType, from_folder: bool = False) -> tuple[DataFrame, DataFrame]:
    """Competitor feeds without those that can't be read to the end, and (path, reason) of these."""
    from lonja.sources.tables import read_competitor_csv
    seen = inspected(spark, path, readable_feed)
    good = [r["path"] for r in seen.where("reason is null").select("path").collect()]  # names of files only
    rows = read_competitor_csv(spark, good, schema, from_folder) if good else spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("fuente", T.StringType())]))
    return rows, seen.where("reason is not null").select("path", "reason")
