import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Tests name the shared folder that a cluster's session would name."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def docs_frame(spark, rows, extra=True):
    """documents(doc_id, text, ...) with columns whose names clash with what operators add."""
    frame = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    if extra:
        frame = frame.selectExpr("*", "'x' AS id", "1 AS component_id", "2 AS keys", "3 AS score", "4L AS length")
    return frame
