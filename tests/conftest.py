import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from kindred.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = f"file://{tmp_path_factory.mktemp('shared')}"
    session = local_session(cores=8, shuffle_partitions=4, app="tests", shared=shared)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Value of a column function for each given string."""

    def run(function, *values):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        out = rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()
        found = [r["o"] for r in out]
        return found[0] if len(found) == 1 else found

    return run
