from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from vigil.plans import bindings as B
from vigil.plans.registry import portable

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@needs_data
@pytest.mark.parametrize(
    "name", ["clean_journal", "state_timeline", "gap_sessions", "asof_at_or_after", "metrics_by_kind"]
)
def test_small_data_agrees_with_sql(spark, name):
    found = entry.queries()[name](spark, DATA)
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    columns = ", ".join(f'"{c}"' for c in found.columns)
    expected = con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in found.collect()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


@needs_data
def test_panel_plan_has_no_pairs_and_no_python(spark):
    plan = B.build_panel(spark, DATA)._jdf.queryExecution().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in plan
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "props" in line]
    assert not scans  # columns the panel does not use are never read


@needs_data
def test_state_filter_reaches_the_scan(spark):
    events = B.table(spark, DATA, "events").where("event_type IN ('error', 'view')")
    plan = events.select("user_id", "ts")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(event_type" in plan


@needs_data
def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert "target_fault_24_48h" in df.columns and df.limit(1).count() == 1
    assert not {"boolean", "date", "tinyint"} & {kind for _, kind in portable(df).dtypes}
