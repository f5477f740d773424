import pytest

from hailbook.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Apply a column function to string values and return the results."""

    def run(function, values, schema="value string"):
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        frame = spark.createDataFrame(list(enumerate(rows)), f"i int, r struct<{schema}>")
        result = frame.select("i", "r.*").select("i", function().alias("out"))
        return [row["out"] for row in result.orderBy("i").collect()]

    return run
