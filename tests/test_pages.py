import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigil.operators import risk as K

SCHEMA = "id string, score double, prediction_time timestamp_ntz, model_version string, factors array<string>, direction string"


@pytest.fixture(scope="module")
def made(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [
        (f"{i * 7919 % 1000:04d}", None if i % 11 == 0 else (i % 13) / 13, start + dt.timedelta(days=i % 5),
         "ab"[i % 2], [str(i)], "sensor")
        for i in range(400)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


def in_order(rows):
    return [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), -r[2].timestamp(), r[0]))]


def ids(df):
    return [r.id for r in df.collect()]


def test_pages_of_any_depth(spark, made, tmp_path):
    rows, df = made
    order = in_order(rows)
    K.write_ranked(df, f"{tmp_path}/ranked", rows=30)
    for offset in (0, 25, 200, 390, 400):
        assert ids(K.ranked_page(spark, f"{tmp_path}/ranked", 20, offset, rows=30)) == order[offset : offset + 20]
    total, page = K.prediction_page(df, 7, 395)
    assert total == 400 and ids(page) == order[395:]
    deep = K.ranked_page(spark, f"{tmp_path}/ranked", 20, 200, rows=30)
    assert len({f for f in deep.inputFiles()}) >= 1
    plan = deep._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(block" in plan and "Offset" not in plan


def test_long_lists_get_wider_blocks(spark, made, tmp_path, monkeypatch):
    rows, df = made
    order = in_order(rows)
    monkeypatch.setattr(K, "RANKED_BLOCKS", 7, raising=False)
    K.write_ranked(df, f"{tmp_path}/ranked", rows=2)
    assert len(list(tmp_path.glob("ranked/block=*"))) == 7
    for offset in (0, 56, 57, 200, 390, 400):
        assert ids(K.ranked_page(spark, f"{tmp_path}/ranked", 20, offset, rows=2)) == order[offset : offset + 20]


def test_pages_follow_each_other(made):
    rows, df = made
    order, seen, after = in_order(rows), [], None
    by_id = {r[0]: r for r in rows}
    while page := ids(K.page_after(df, after, 90)):
        seen += page
        last = by_id[page[-1]]
        after = (last[1], last[2], last[0])
    assert seen == order


def test_store_appends_each_id_once_and_reads_candidates_only(spark, made, tmp_path):
    rows, df = made
    path = f"{tmp_path}/store"
    K.append_to_store(df.where("model_version = 'a'"), path)
    K.append_to_store(df, path)
    K.append_to_store(df.unionAll(df), path)
    stored = spark.read.parquet(path)
    assert sorted((r.id, r.factors) for r in stored.collect()) == sorted((r[0], r[4]) for r in rows)
    day = dt.datetime(2024, 1, 3)
    new = df.where((F.col("prediction_time") == day) & (F.col("model_version") == "a"))
    found = K.candidates(stored, new.withColumn("prediction_day", F.to_date("prediction_time")))
    assert found.count() == sum(r[2] == day and r[3] == "a" for r in rows)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "prediction_day" in plan.split("PartitionFilters: [")[1].split("]")[0]
