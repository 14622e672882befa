import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    built = (
        SparkSession.builder.master("local[4]").appName("marlstone-tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    built.sparkContext.setLogLevel("ERROR")
    return built
