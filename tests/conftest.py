import pytest

from keystead.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def one(spark):
    """Value of a column expression over literal columns: one(fn, text, ...)."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        return spark.range(1).select(fn(*[F.lit(v) for v in values]).alias("x")).first()["x"]

    return run
