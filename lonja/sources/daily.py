"""A bounded pull by day as a data source: one task per day, and a stream that resumes.

``spark.read.format("lonja_daily")`` with options ``path`` (a folder of parquet files by month, ``mes=YYYY-MM/``), ``fecha`` (the day
column), ``ini`` and ``fin`` (inclusive). A day's task opens the files of its month only. As a stream, offsets are days: a batch
takes all days up to ``fin``, and a restart (with a later ``fin``, or after a failure) goes on after the last committed day.

The days come from the options and not from pushed filters: Spark keeps what a Python source pushed with the table, so a frame
that is filtered twice would keep its first filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Day(InputPartition):
    def __init__(self, day: date):
        super().__init__(day.toordinal())
        self.day = day


def _day(v) -> date:
    return v if isinstance(v, date) else date.fromisoformat(str(v)[:10])


def _pull(options: dict, names: list[str], day: date) -> Iterator[pa.RecordBatch]:
    """The rows of one day, from the files of its month."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    path = options["path"]
    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    folder = f"{inner}/mes={day:%Y-%m}"
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return
    files = ds.dataset(folder, filesystem=store, format="parquet")
    yield from files.to_batches(columns=names, filter=ds.field(options.get("fecha", "fecha")) == day)


class DailyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, dict(options)
        self.ini, self.fin = _day(options["ini"]), _day(options["fin"])

    def partitions(self) -> list[Day]:
        return [Day(self.ini + timedelta(days=k)) for k in range((self.fin - self.ini).days + 1)]

    def read(self, partition: Day | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # None: there is no day
            yield from _pull(self.options, self.names, partition.day)


class DailyStream(DataSourceStreamReader):
    """Offsets name the next day to read."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, dict(options)

    def initialOffset(self) -> dict:
        return {"day": self.options["ini"]}

    def latestOffset(self) -> dict:
        return {"day": (_day(self.options["fin"]) + timedelta(days=1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        a, b = _day(start["day"]), _day(end["day"])
        if b < a:
            raise ValueError(f"days up to {a} are pulled already; fin can't go back to {b}")
        return [Day(a + timedelta(days=k)) for k in range((b - a).days)]

    def read(self, partition: Day) -> Iterator[pa.RecordBatch]:
        yield from _pull(self.options, self.names, partition.day)


class DailyPull(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lonja_daily"

    def reader(self, schema: StructType) -> DailyReader:
        return DailyReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DailyStream:
        return DailyStream(schema, self.options)


def read_days(spark: SparkSession, path: str, schema: StructType | str, ini: date, fin: date, fecha: str = "fecha") -> DataFrame:
    """The rows of the days ``ini`` to ``fin``."""
    spark.dataSource.register(DailyPull)
    return spark.read.format("lonja_daily").schema(schema).options(path=path, fecha=fecha, ini=str(ini), fin=str(fin)).load()


def stream_days(spark: SparkSession, path: str, schema: StructType | str, ini: date, fin: date, fecha: str = "fecha") -> DataFrame:
    """The same days as a stream."""
    spark.dataSource.register(DailyPull)
    return spark.readStream.format("lonja_daily").schema(schema).options(path=path, fecha=fecha, ini=str(ini), fin=str(fin)).load()
