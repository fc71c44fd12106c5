"""Every registered query against its SQL, and what its plan must not contain."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))

import check_sql  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402
from stratalens.plans.catalog import QUERIES, SQL  # noqa: E402

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return check_sql.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    verdict, _ = check_sql.compare(spark, duck, name, SMALL, allow_empty=True)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def executed_plan(frame) -> list[str]:
    """Lines of the final plan, without the plans that adaptive execution started from."""
    lines, skip = [], None
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[\s:|+-]*", line).group(0))
        if skip is not None and depth >= skip:
            continue
        skip = depth if "== Initial Plan ==" in line else None
        if skip is None:
            lines.append(line)
    return lines


def scans(lines, table):
    return sum(bool(re.search(rf"FileScan parquet .*/{table}\.parquet", line)) for line in lines)


@pytest.mark.parametrize(
    "name, survey, population",
    [
        ("match_country_segment", "orders", "customer"),
        ("scorecard_full_overall", "orders", "customer"),
        ("wave_trend", "orders", "customer"),
        ("strategic_score", "orders", "customer"),
        ("deviations", "labels", "documents"),
        ("top_contributors", "labels", "documents"),
        ("windowed_match", "events", "events"),
        ("cumulative_match", "events", "events"),
    ],
)
def test_respondents_are_read_once(spark, name, survey, population):
    frame = QUERIES[name](spark, SMALL)
    frame.collect()
    lines = executed_plan(frame)
    text = "\n".join(lines)
    # The population table is read for the benchmark and, joined, for the survey; events are both.
    assert scans(lines, survey) == 1
    assert scans(lines, population) == (1 if survey == population else 2)
    for bad in ("NestedLoopJoin", "CartesianProduct", "EvalPython", "MapInPandas"):
        assert bad not in text


@pytest.mark.parametrize("name", ["fix_impact", "agreement_scores", "neyman", "replicate_scores", "subsample_stability_auto", "subsample_stability_listed", "cumulative_match", "weight_shift"])
def test_no_keyless_join_or_python(spark, name):
    frame = QUERIES[name](spark, SMALL)
    frame.collect()
    text = "\n".join(executed_plan(frame))
    for bad in ("NestedLoopJoin", "CartesianProduct", "EvalPython", "MapInPandas"):
        assert bad not in text


def test_scans_read_only_what_they_need(spark):
    frame = QUERIES["scorecard_all"](spark, SMALL)
    text = frame._jdf.queryExecution().executedPlan().toString()
    schemas = set(re.findall(r"orders\.parquet.*?ReadSchema: struct<([^>]*)>", text))
    assert schemas == {"o_custkey:bigint"}


def test_codes_halfway_between_two_agree_with_sql(spark, tmp_path):
    """Balances whose code is halfway: 0.5, 1.5, 2.5 and 3.5 go to 0, 2, 2 and 4, below zero and above."""
    rows = [(i, 3, balance) for i, balance in enumerate([1250.0, -1250.0, 3750.0, 6250.0, -6250.0, 8750.0, 1250.01, 3749.99, None])]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet/")
    nation = spark.read.parquet(f"{SMALL}/nation.parquet")
    nation.write.parquet(f"{tmp_path}/nation.parquet/")
    duck = check_sql.duckdb.connect()
    for name in ("customer", "nation"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert check_sql.compare(spark, duck, "code_labels", str(tmp_path))[0] == "ok, 3 rows"
    got = {r["gender"]: r["n"] for r in QUERIES["code_labels"](spark, str(tmp_path)).collect()}
    assert got == {"Male": 2, "Female": 3, None: 4}
