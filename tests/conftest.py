import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = (SparkSession.builder.master("local[4]").appName("fieldscope-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.warehouse.dir", str(warehouse))
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached(spark):
    """Frames that a module cached are no part of the next one's session."""
    yield
    spark.catalog.clearCache()


@pytest.fixture
def one(spark):
    """Evaluate a column expression over one row of named values."""
    def evaluate(column, schema="x string", *values):
        values = values or (None,)
        return spark.createDataFrame([tuple(values)], schema).select(column.alias("r")).first()["r"]
    return evaluate


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
