import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stratalens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        app="stratalens-tests",
        spark_sql_shuffle_partitions="4",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
        spark_driver_memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def survey_of(spark):
    """Respondents from ``(count, values...)`` groups."""

    def build(columns, *groups):
        rows = [tuple(values) for count, *values in groups for _ in range(count)]
        return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))

    return build


@pytest.fixture
def benchmark_of(spark):
    """Benchmark from ``(values..., share)`` rows."""

    def build(columns, *rows):
        return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns) + ", population_share double")

    return build


def rows_of(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())
