from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """Documents from ``(doc_id, text)`` pairs, with extra columns whose names operators use inside."""

    def build(rows, kind="bigint"):
        frame = spark.createDataFrame(list(rows), f"doc_id {kind}, text string")
        return frame.selectExpr(
            "'x' AS salt", "doc_id", "1 AS position", "text", "'y' AS label", "2 AS n", "'z' AS node", "3 AS key", "'w' AS row", "4 AS tail"
        )

    return build


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("test tables are not here")
    return SMALL
