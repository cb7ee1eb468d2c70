import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import evaluate as E
from vigil.operators import model as M
from vigil.operators import splits as SP

SCHEMA = "channel_id string, g string, y int, p double, w double"


def brute_auc(rows):
    pos = [p for _, _, y, p, _ in rows if y]
    neg = [p for _, _, y, p, _ in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


def test_first_golden(spark):
    rows = [("a", "x", y, p, 1.0) for y, p in zip((0, 0, 1, 1), (0.1, 0.2, 0.8, 0.9))]
    curve = E.pr_curve(spark.createDataFrame(rows, SCHEMA), "y", "p")
    for policy in ("joint_f1", "joint_recall", "f2"):
        best = E.select_threshold(curve, policy).first()
        assert 0.2 < best["threshold"] <= 0.8


def test_curve_against_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (str(rng.randrange(9)), "x", rng.randrange(2), rng.choice([0.0, 1.0, round(rng.random(), 2)]), 1.0)
        for _ in range(500)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    curve = E.pr_curve(df, "y", "p")
    rank = E.ranking_metrics(curve).first()
    assert rank["roc_auc"] == pytest.approx(brute_auc(rows))
    total = sum(r[2] for r in rows)
    area, before = 0.0, 0.0
    for level in sorted({r[3] for r in rows}, reverse=True):
        chosen = [r for r in rows if r[3] >= level]
        tp = sum(r[2] for r in chosen)
        area += (tp / total - before) * tp / len(chosen)
        before = tp / total
    assert rank["average_precision"] == pytest.approx(area)
    weighted = E.ranking_metrics(E.pr_curve(df.withColumn("w", F.lit(3.0)), "y", "p", "w")).first()
    assert weighted["average_precision"] == pytest.approx(area)


def test_groups_with_one_class_and_null(spark):
    rows = [("a", "x", 0, 0.4, 1.0), ("a", "x", 0, 0.6, 1.0)]
    rows += [("a", None, 1, 0.7, 1.0), ("a", None, 0, 0.2, 1.0)]
    found = {
        r["g"]: r
        for r in E.metrics(spark.createDataFrame(rows, SCHEMA), "y", "p", 0.5, by=["g"]).collect()
    }
    assert found["x"]["roc_auc"] is None and found["x"]["average_precision"] is None
    assert found["x"]["recall"] == 0.0 and found["x"]["fp"] == 1
    assert found[None]["roc_auc"] == 1.0 and found[None]["f1"] == 1.0


def test_no_feasible_threshold_takes_best_f1(spark):
    rows = [("a", "x", int(i % 4 == 0), i / 100, 1.0) for i in range(100)]
    best = E.select_threshold(E.pr_curve(spark.createDataFrame(rows, SCHEMA), "y", "p"), "joint_f1")
    assert not best.first()["feasible"]


def test_reliability_bins_are_closed_on_the_right(spark):
    rows = [("a", "x", i % 2, (i + 1) / 10, 1.0) for i in range(9)]
    found = E.reliability(spark.createDataFrame(rows, SCHEMA), "y", "p", 4).orderBy("bin").collect()
    assert [r["rows"] for r in found] == [3, 2, 2, 2]


def test_bootstrap_interval_surrounds_the_estimate(spark):
    rng = random.Random(1)
    rows = []
    for c in range(60):
        for _ in range(10):
            y = rng.randrange(2)
            rows.append((str(c), "x", y, min(1.0, max(0.0, 0.3 * y + rng.random() * 0.7)), 1.0))
    df = spark.createDataFrame(rows, SCHEMA)
    point = E.threshold_metrics(df, "y", "p", 0.5).first()
    found = E.cluster_bootstrap(df, "channel_id", "y", "p", 0.5, repeats=200).collect()
    for r in found:
        assert r["low_95"] < point[r["metric"]] < r["high_95"]


# alerts and positives of three channels, one of them without a name
CLUSTERS = {"a": (3, 1, 2), "b": (1, 4, 0), None: (2, 2, 5)}


def cluster_rows(spark):
    rows = []
    for c, (tp, fp, fn) in CLUSTERS.items():
        rows += [(c, "x", 1, 0.9, 1.0)] * tp + [(c, "x", 0, 0.9, 1.0)] * fp + [(c, "x", 1, 0.1, 1.0)] * fn
    return spark.createDataFrame(rows, SCHEMA)


def drawn_metrics(repeat):
    """Precision, recall and F1 of three channels drawn with replacement."""

    def digest(text):
        return hashlib.md5(text.encode()).hexdigest()

    order = [*sorted(["a", "b"], key=lambda c: (digest(c)[:3], c)), None]
    drawn = [CLUSTERS[order[int(digest(f"2026|{repeat}|{i}")[:12], 16) % 3]] for i in range(3)]
    tp, fp, fn = (sum(d[k] for d in drawn) for k in range(3))
    return {"precision": tp / (tp + fp), "recall": tp / (tp + fn), "f1": 2 * tp / (2 * tp + fp + fn)}


def test_every_repeat_draws_as_many_channels_as_there_are(spark):
    found = {r["repeat"]: r for r in E.bootstrap_draws(cluster_rows(spark), "channel_id", "y", "p", 0.5).collect()}
    assert sorted(found) == list(range(1, 401))
    for repeat, r in found.items():
        assert {m: r[m] for m in ("precision", "recall", "f1")} == pytest.approx(drawn_metrics(repeat))


def test_draws_are_opened_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(E, "DRAWS", 1000)
    channels = spark.range(100).select(F.col("id").alias("_index"), F.lit(100).cast("long").alias("_total"))
    drawn = E.opened_draws(channels, 400, 2026).withColumn("_task", F.spark_partition_id())
    tasks = drawn.groupBy("_task").count().collect()
    assert sum(r["count"] for r in tasks) == 100 * 400
    assert max(r["count"] for r in tasks) < 100 * 400 / 4


def test_no_rows_have_no_draws(spark):
    none = cluster_rows(spark).limit(0)
    assert E.bootstrap_draws(none, "channel_id", "y", "p", 0.5).count() == 0
    assert E.cluster_bootstrap(none, "channel_id", "y", "p", 0.5).count() == 0


def test_intervals_are_those_of_draws_with_replacement(spark):
    draws = [drawn_metrics(repeat) for repeat in range(1, 401)]
    for r in E.cluster_bootstrap(cluster_rows(spark), "channel_id", "y", "p", 0.5).collect():
        low, high = np.quantile([d[r["metric"]] for d in draws], [0.025, 0.975])
        assert (r["low_95"], r["high_95"]) == pytest.approx((low, high))


def model_rows(spark, n=600, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.random(), rng.random()
        y = int(a + 0.2 * rng.random() > 0.6)
        rows.append((str(i), a, b if i % 5 else None, y, i % 3 != 0, 1.0))
    schema = "channel_id string, fa double, fb double, target_monthly int, eligible boolean, w double"
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    return spark.createDataFrame(rows, schema).withColumn("prediction_time", day)


def test_selection_scoring_and_storage(spark, tmp_path):
    splits = {s: model_rows(spark, seed=i) for i, s in enumerate(("train", "validation", "test"))}
    chosen, results = M.fit_select(
        splits, ["fa", "fb"], "target_monthly", weight="w", iterations=5, depth=2
    )
    assert {r["kind"] for r in results} == {"logistic", "trees"}
    assert results[-1]["split"] == "test" and results[-1]["average_precision"] > 0.8
    scored = M.score(splits["test"], chosen)
    assert scored.count() == 600
    assert scored.where("not eligible and risk_probability is not null").count() == 0
    assert scored.where("eligible and risk_probability is null").count() == 0
    assert scored.where("alert is null and eligible").count() == 0

    M.save(spark, chosen, str(tmp_path))
    again = M.load(spark, str(tmp_path), ["fa", "fb"])
    with pytest.raises(ValueError):
        M.load(spark, str(tmp_path), ["fb", "fa"])
    gap = M.largest_difference(
        scored, M.score(splits["test"], again), ["channel_id"], "risk_probability"
    ).first()
    assert gap["max_difference"] < 1e-12 and gap["unmatched"] == 0

    flipped = splits["test"].withColumn("target_monthly", 1 - F.col("target_monthly"))
    gap = M.largest_difference(
        scored, M.score(flipped, chosen), ["channel_id"], "risk_probability"
    ).first()
    assert gap["max_difference"] == 0.0
    with pytest.raises(PermissionError):
        M.evaluate_once(splits["test"], chosen, "target_monthly")


def test_folds_are_opened_once_for_all_fits(spark):
    day = F.make_timestamp_ntz(2021 + F.col("channel_id").cast("int") % 3, *[F.lit(n) for n in (3, 1, 0, 0, 0)])
    rows = model_rows(spark).withColumn("prediction_time", day)
    rows = rows.withColumn("target_end", F.col("prediction_time") + F.expr("interval 48 hours"))
    folds = SP.expanding_folds(rows, [2022, 2023], "2021-01-01")
    features = ["fa", "fb"]
    found = M.out_of_fold(folds, [2022, 2023], features, "target_monthly", weight="w")
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == [*folds.columns, "probability"] and found.count() == 400
    for year in (2022, 2023):
        fitted = M.fit(rows.where(F.year("prediction_time") < year), features, "target_monthly", "logistic", "w")
        alone = M.probability(rows.where(F.year("prediction_time") == year), fitted)
        gap = M.largest_difference(found.where(F.col("fold") == year), alone, ["channel_id"], "probability").first()
        assert gap["max_difference"] < 1e-9 and gap["unmatched"] == 0


def test_calibration(spark):
    rng = random.Random(4)
    rows = [("a", "x", int(rng.random() < p * 0.5), p, 1.0) for p in [rng.random() for _ in range(900)]]
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = E.fit_calibration(df, "y", "p")
    assert fitted["coef"] > 0
    upside_down = E.fit_calibration(df.withColumn("p", 1 - F.col("p")), "y", "p")
    assert upside_down["coef"] == 1.0 and upside_down["intercept"] == 0.0
    raw = E.probability_metrics(df, "y", "p").first()
    better = df.withColumn("q", E.apply_calibration(F.col("p"), fitted))
    assert E.probability_metrics(better, "y", "q").first()["brier"] < raw["brier"]
