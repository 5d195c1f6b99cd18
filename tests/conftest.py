import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def detect_text(spark):
    """Findings of one text, by line number."""
    from beaconaudit import LIVE, detect

    def run(text, path="/r/p/src/app.ts", rulebook=LIVE, **options):
        files = spark.createDataFrame([(path, text)], "path string, content string")
        return {r["line_number"]: r for r in detect(files, rulebook, **options).collect()}

    return run
