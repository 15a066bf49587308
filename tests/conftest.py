import pathlib
import sys
import tempfile

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from formspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", 4, "4g", tempfile.mkdtemp(prefix="run-", dir="/tmp"))


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named texts."""
    from pyspark.sql import functions as F

    def run(column, **values):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        return df.select(column.alias("out")).first()["out"]
    return run
