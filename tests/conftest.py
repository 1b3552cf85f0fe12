import pytest

from plumbline.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session(
        "plumbline-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "6g"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sample(spark):
    """The ten-row table used for hand-derived results."""
    rows = [(1, 0.5, "a", 10, 1), (2, 0.3, "b", 20, 0), (3, 0.8, "a", 15, 1), (4, 0.2, "c", 25, 0), (5, 0.9, "b", 30, 1),
            (6, 0.1, "a", 12, 0), (7, 0.7, "c", 18, 1), (8, 0.4, "b", 22, 0), (9, 0.6, "a", 28, 1), (10, 0.35, "c", 16, 0)]
    return spark.createDataFrame(rows, "id bigint, feature1 double, feature2 string, feature3 bigint, target bigint")
