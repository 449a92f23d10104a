import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from sylvaq.ship import ship

    ship(s)
    yield s


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted plain tuples."""

    def get(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return get
