import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of one column expression over single-column inputs `c`."""

    def values(inputs, expression, type_="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, c {type_}")
        return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]

    return values
