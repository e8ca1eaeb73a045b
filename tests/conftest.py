import pytest
from pyspark.sql import Row

from arcline.session import SLICE_ROWS_CONF, build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[4]", shuffle_partitions=4, extra={"spark.driver.memory": "4g"}
    )
    yield session
    session.stop()


@pytest.fixture
def slices(spark):
    """Set the rows a task may hold per key; restored afterwards."""

    def use(rows: int):
        spark.conf.set(SLICE_ROWS_CONF, str(rows))

    yield use
    spark.conf.unset(SLICE_ROWS_CONF)


@pytest.fixture
def rows(spark):
    def values(df, *order):
        ordered = df.orderBy(*order) if order else df
        return [tuple(r) for r in ordered.collect()]

    return values


@pytest.fixture
def frame(spark):
    def build(schema, *data):
        return spark.createDataFrame([d if isinstance(d, (tuple, Row)) else (d,) for d in data], schema)

    return build
