import csv
import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from vigil.operators import risk as K
from vigil.operators import splits as SP
from vigil.sources import dictionaries as D
from vigil.sources import tables as T


def test_export_keeps_the_ranked_order(spark, tmp_path):
    scored = spark.range(5000, numPartitions=7).select(
        F.concat(F.lit("="), F.col("id")).alias("id"),
        F.when(F.col("id") % 50 != 0, F.pmod(F.hash("id"), F.lit(97)) / 97).alias("score"),
        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("prediction_time"),
    )
    every = [F.lit("x").alias(c) for c in T.fv.EXPORT_FIELDS if c not in scored.columns]
    path = tmp_path / "export"
    T.export_csv(K.ranked(scored.select("*", *every)), str(path))
    rows = []
    for file in sorted(Path(path).glob("part-*")):
        with file.open(newline="") as lines:
            rows += [(r["score"], r["id"]) for r in csv.DictReader(lines)]
    assert len(rows) == 5000 and all(i.startswith("'=") for _, i in rows)
    order = [(-float(s) if s else 1.0, i[1:]) for s, i in rows]
    assert order == sorted(order)


def test_fold_years_come_from_the_rows(spark):
    days = [dt.datetime(y, m, 3) for y, m in ((2019, 5), (2020, 1), (2021, 6), (2021, 7), (2023, 2))] + [None]
    rows = spark.createDataFrame([(d,) for d in days], "prediction_time timestamp_ntz")
    assert SP.fold_years(rows, "2020-01-01") == [2021, 2023]
    assert SP.fold_years(rows, "2023-01-01") == []
    ended = rows.withColumn("target_end", F.col("prediction_time") + F.expr("interval 2 days"))
    folds = SP.expanding_folds(ended, [2021, 2023], "2020-01-01").groupBy("fold", "role").count().collect()
    assert {(r["fold"], r["role"]): r["count"] for r in folds} == {
        (2021, "train"): 1, (2021, "validation"): 2, (2023, "train"): 3, (2023, "validation"): 1,
    }


def test_retired_versions_are_left_out(spark):
    rows = spark.createDataFrame(
        [("sensor", "new", 1, 0.5), ("sensor", "old", 9, 0.9), ("smoke", "new", 1, 0.7), ("sensor", "new", 2, 0.1)],
        "direction string, model_version string, prediction_time int, score double",
    )
    models = {"sensor": {"version": "new"}}
    assert {r.score for r in K.active(rows, models, latest=False).collect()} == {0.5, 0.1}
    assert {r.score for r in K.active(rows, models).collect()} == {0.1}


def test_plans_and_dictionaries_from_text(spark, tmp_path):
    repair = tmp_path / "repair.csv"
    repair.write_text("object_label,sensor_count,dismantle_start,extra\nA,3,2024-01-02T03:04:05,x\nB,,,y\n", encoding="utf-8")
    rows = D.read_table(spark, str(repair), D.REPAIR_PLAN_SCHEMA)
    assert rows.columns == [f.name for f in D.REPAIR_PLAN_SCHEMA]
    got = {r.object_label: r for r in rows.collect()}
    assert got["A"].sensor_count == 3 and got["A"].dismantle_start == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got["B"].sensor_count is None and got["B"].division is None
    equipment = tmp_path / "equipment.csv"
    equipment.write_text("equipment,quantity,source_row\npump,2,7\n", encoding="utf-8")
    row = D.read_table(spark, str(equipment), D.EQUIPMENT_SCHEMA).first()
    assert (row.equipment, row.quantity, row.unit, row.source_row) == ("pump", 2, None, 7)
