import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame of rows, with columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    def make(rows, schema, extra=()):
        df = spark.createDataFrame(rows, schema)
        return df.withColumns({name: F.lit(7) for name in extra}) if extra else df

    return make
