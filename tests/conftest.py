import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parcelwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "parcelwise-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one column over named string/number inputs."""
    from pyspark.sql import functions as F

    def run(make, *inputs):
        df = spark.range(1).select(*[F.lit(v).alias(f"i{n}") for n, v in enumerate(inputs)])
        return df.select(make(*[F.col(f"i{n}") for n in range(len(inputs))]).alias("v")).first()["v"]

    return run
