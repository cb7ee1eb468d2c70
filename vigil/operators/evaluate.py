"""Evaluation of scored rows: curves, thresholds, metrics, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import scalars as S
from vigil.operators.ordered import FIRST
from vigil.operators.quantiles import with_quantiles
from vigil.operators.ranges import positions, running
from vigil.session import materialize

EPS = 1e-8
#: Draws of a bootstrap that one task opens, about.
DRAWS = 1 << 18


def scored(score: Column) -> Column:
    """A score that is a number; rows without one are unscored and stay out of curves and means."""
    return score.isNotNull() & ~F.isnan(score.cast("double"))


def clipped(score: Column, edge: float = EPS) -> Column:
    """Probability away from 0 and 1; NULL for a missing score (least and greatest would skip it)."""
    return F.when(scored(score), F.greatest(F.least(score, F.lit(1 - edge)), F.lit(edge)))


def _alert(score: str, level: Column) -> Column:
    """An unscored row raises no alert."""
    return F.coalesce(scored(F.col(score)) & (F.col(score) >= level), F.lit(False))


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1)


def by_score(
    df: DataFrame,
    label: str,
    score: str,
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per distinct score: positives, rows, sums of squares for Brier."""
    w = _weight(weight)
    return df.where(scored(F.col(score))).groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(w * F.col(label)).alias("tp"), F.sum(w).alias("n")
    )


def pr_curve(
    df: DataFrame,
    label: str,
    score: str,
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall and F1 at every distinct score.

    Rows are first reduced to distinct scores; those are cut into ranges of
    about equal size, whose running totals carry on from piece to piece, so the
    curve is exact and no window ever holds all scores.
    """
    scores = by_score(df, label, score, weight, by)
    totals = {"cum_tp": F.col("tp"), "cum_n": F.col("n")}
    whole = {"positives": "cum_tp", "total": "cum_n"}
    run = running(scores, by, [F.desc("threshold")], totals, whole)
    precision = F.col("cum_tp") / F.col("cum_n")
    recall = F.col("cum_tp") / F.nullif(F.col("positives"), F.lit(0))
    total = precision + recall
    return run.select(
        *by,
        "threshold",
        "tp",
        "n",
        "cum_tp",
        "cum_n",
        "positives",
        "total",
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(2 * precision * recall / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("f1"),
        (5 * precision * recall / (4 * precision + recall + F.lit(1e-12))).alias("f2"),
    )


def ranking_metrics(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision (step sum) and ROC-AUC with tied scores shared.

    AP is NULL without positives, AUC is NULL when a class is missing.
    """
    positives, total = F.max("positives"), F.max("total")
    negatives = total - positives
    gain = F.sum(F.col("tp") / F.nullif(F.col("positives"), F.lit(0)) * F.col("precision"))
    wins = F.sum((F.col("n") - F.col("tp")).cast("double") * (F.col("cum_tp") - F.col("tp") / 2))
    return curve.groupBy(*by).agg(
        gain.alias("average_precision"),
        (wins / F.nullif(positives.cast("double") * negatives.cast("double"), F.lit(0.0))).alias("roc_auc"),
    )


def select_threshold(curve: DataFrame, policy: str, by: Sequence[str] = ()) -> DataFrame:
    """Threshold of a curve under one of three policies.

    joint_f1      precision > 0.7 and recall > 0.5, then the best F1
    joint_recall  the same condition, then the best recall
    f2            the best F2
    Where no threshold meets the condition, the first two take the best F1.
    """
    p, r, t = F.col("precision"), F.col("recall"), F.col("threshold")
    feasible = F.coalesce((p > 0.7) & (r > 0.5), F.lit(False))
    rank = {
        "joint_f1": F.struct(feasible, F.col("f1"), p, r, -t),
        "joint_recall": F.struct(
            feasible, F.when(feasible, r).otherwise(F.col("f1")).alias("_q"), -t
        ),
        "f2": F.struct(F.col("f2"), -t),
    }[policy]
    best = F.max_by(
        F.struct("threshold", "precision", "recall", "f1", "f2", feasible.alias("feasible")), rank
    )
    chosen = curve.groupBy(*by).agg(best.alias("_best"))
    fields = ["threshold", "precision", "recall", "f1", "f2", "feasible"]
    return chosen.select(*by, *[F.col(f"_best.{f}").alias(f) for f in fields])


def candidate_summary(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What a candidate reaches: recall at P > 0.7, precision at R > 0.5, F1, AP."""
    p, r = F.col("precision"), F.col("recall")
    gain = F.sum(F.col("tp") / F.nullif(F.col("positives"), F.lit(0)) * p)
    return curve.groupBy(*by).agg(
        gain.alias("average_precision"),
        F.coalesce(F.max(F.when(p > 0.7, r)), F.lit(0.0)).alias("recall_at_precision_gt_07"),
        F.coalesce(F.max(F.when(r > 0.5, p)), F.lit(0.0)).alias("precision_at_recall_gt_05"),
        F.coalesce(F.bool_or((p > 0.7) & (r > 0.5)), F.lit(False)).alias("feasible"),
        F.max("f1").alias("max_f1"),
    )


def threshold_metrics(
    df: DataFrame,
    label: str,
    score: str,
    threshold: float | Column,
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Confusion counts and what follows from them at one threshold, per group."""
    y, w = F.col(label), _weight(weight)
    level = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    alert = _alert(score, level)

    def amount(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, w)), F.lit(0))

    counts = df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        S.count_if(y == 1).alias("positives"),
        F.max(level).alias("threshold"),
        S.count_if(alert).alias("alerts"),
        S.count_if(alert & (y == 1)).alias("tp"),
        S.count_if(alert & (y == 0)).alias("fp"),
        S.count_if(~alert & (y == 1)).alias("fn"),
        S.count_if(~alert & (y == 0)).alias("tn"),
        amount(alert & (y == 1)).alias("_tp"),
        amount(alert & (y == 0)).alias("_fp"),
        amount(~alert & (y == 1)).alias("_fn"),
        (F.sum(w * y) / F.sum(w)).alias("prevalence"),
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")

    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))

    return counts.withColumns(
        {
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "f1": share(2 * tp, 2 * tp + fp + fn),
            "f2": share(5 * tp, 5 * tp + fp + 4 * fn),
            "alerts_per_1000": F.lit(1000.0) * F.col("alerts") / F.col("rows"),
        }
    ).drop("_tp", "_fp", "_fn")


def metrics(
    df: DataFrame,
    label: str,
    score: str,
    threshold: float,
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Threshold metrics together with AP and AUC, per group; a NULL group stays."""
    at = threshold_metrics(df, label, score, threshold, weight, by)
    rank = ranking_metrics(pr_curve(df, label, score, weight, by), by)
    keys = [F.col(c) for c in by]
    held = F.struct(*keys, F.lit(0).alias("_"))
    return (
        at.withColumn("_by", held)
        .join(rank.withColumn("_by", held).drop(*by), "_by")
        .drop("_by")
    )


def threshold_grid(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float], chosen: float
) -> DataFrame:
    """Metrics at a fixed list of thresholds, the chosen one marked.

    The rows are read once: every row opens its highest threshold only, and
    running sums over the short list give the counts of all of them.
    """
    levels = sorted({float(chosen), *map(float, thresholds)})
    level_array = F.lit(levels)
    rank = F.size(F.filter(level_array, lambda level: level <= F.col(score)))
    reached = df.groupBy(rank.alias("_rank")).agg(
        S.count_if(F.col(label) == 1).alias("_pos"), S.count_if(F.col(label) == 0).alias("_neg")
    )
    spark = df.sparkSession
    grid = spark.createDataFrame([(0, None), *enumerate(levels, 1)], "_rank int, threshold double")
    # One row per threshold of the list.
    down = Window.orderBy(F.desc("_rank")).rowsBetween(FIRST, 0)
    whole = Window.orderBy(F.desc("_rank")).rowsBetween(FIRST, Window.unboundedFollowing)
    filled = grid.join(reached, "_rank", "left").fillna(0, ["_pos", "_neg"])
    counted = filled.withColumns(
        {
            "tp": F.sum("_pos").over(down),
            "fp": F.sum("_neg").over(down),
            "fn": F.sum("_pos").over(whole) - F.sum("_pos").over(down),
            "tn": F.sum("_neg").over(whole) - F.sum("_neg").over(down),
        }
    ).where(F.col("threshold").isNotNull())
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))

    return counted.select(
        "threshold",
        (F.col("threshold") == F.lit(float(chosen))).alias("is_optimum"),
        "tp",
        "fp",
        "fn",
        "tn",
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(5 * tp, 5 * tp + fp + 4 * fn).alias("f2"),
    )


def probability_metrics(
    df: DataFrame, label: str, score: str, weight: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Brier score and log-loss of clipped probabilities over the scored rows."""
    df = df.where(scored(F.col(score)))
    p = clipped(F.col(score))
    y, w = F.col(label), _weight(weight)
    loss = -F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return df.groupBy(*by).agg(
        (F.sum(w * (p - y) * (p - y)) / F.sum(w)).alias("brier"),
        (F.sum(w * loss) / F.sum(w)).alias("log_loss"),
    )


def quantile_edges(df: DataFrame, score: str, bins: int) -> DataFrame:
    """Exact interpolated quantiles as one row with an array, without one big sort.

    Rows are reduced to distinct scores with running counts over ranges; a
    score holds the places between the count before it and its own, and only
    scores that hold a wanted place are kept.
    """
    counts = df.where(scored(F.col(score))).groupBy(F.col(score).alias("_v")).agg(
        F.count("*").alias("_n")
    )
    run = running(counts, [], [F.asc("_v")], {"_cum": F.col("_n")}, {"_total": "_cum"})
    fractions = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    places = F.transform(
        fractions, lambda f, i: F.struct(i.alias("i"), ((F.col("_total") - 1) * f).alias("place"))
    )

    def held(place: Column) -> Column:
        return (place >= F.col("_cum") - F.col("_n")) & (place < F.col("_cum"))

    wanted = F.filter(places, lambda p: held(F.floor(p["place"])) | held(F.ceil(p["place"])))
    hits = run.select("_v", "_cum", "_n", F.explode(wanted).alias("_p"))
    place = F.col("_p.place")
    ends = hits.groupBy("_p").agg(
        F.min(F.when(held(F.floor(place)), F.col("_v"))).alias("_low"),
        F.min(F.when(held(F.ceil(place)), F.col("_v"))).alias("_high"),
    )
    edge = F.col("_low") + (F.col("_high") - F.col("_low")) * (place - F.floor(place))
    # one row a quantile
    found = ends.agg(F.array_sort(F.collect_list(F.struct(F.col("_p.i").alias("i"), edge.alias("edge")))).alias("_e"))
    return found.select(F.col("_e.edge").alias("edges"))


def reliability(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean probability and event rate per quantile bin, bins closed on the right."""
    one = F.lit(1)
    edges = quantile_edges(df, score, bins).withColumn("_one", one)
    # A global aggregate: exactly one row.
    placed = df.where(scored(F.col(score))).withColumn("_one", one).join(F.broadcast(edges), "_one")
    inner = F.slice(F.array_distinct("edges"), 2, bins)
    number = F.size(F.filter(inner, lambda edge: edge < F.col(score)))
    return placed.groupBy(number.alias("bin")).agg(
        F.count("*").alias("rows"),
        F.avg(score).alias("mean_probability"),
        F.avg(F.col(label)).alias("event_rate"),
    )


def cluster_counts(df: DataFrame, key: str, label: str, score: str, threshold: float) -> DataFrame:
    alert, y = _alert(score, F.lit(float(threshold))), F.col(label)
    return df.groupBy(F.col(key).cast("string").alias("_key")).agg(
        S.count_if(alert & (y == 1)).alias("tp"),
        S.count_if(alert & (y == 0)).alias("fp"),
        S.count_if(~alert & (y == 1)).alias("fn"),
    )


def opened_draws(numbered: DataFrame, repeats: int, seed: int) -> DataFrame:
    """One draw per channel and repeat: ``repeat`` and the ``_index`` of the channel drawn.

    Channels are few bytes before they open their draws, and adaptive execution
    would join them in one task; a stated number of partitions stays as it is.
    """
    pieces = 1 + numbered.count() * repeats // DRAWS
    slots = numbered.repartition(pieces, "_index").select(
        "_index", "_total", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")
    )
    text = F.concat_ws("|", F.lit(str(seed)), F.col("repeat"), F.col("_index"))
    number = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    return slots.select("repeat", (number % F.col("_total")).alias("_index"))


def bootstrap_draws(
    df: DataFrame,
    key: str,
    label: str,
    score: str,
    threshold: float,
    repeats: int = 400,
    seed: int = 2026,
) -> DataFrame:
    """Metrics of each bootstrap repeat, whole channels drawn with replacement.

    A repeat draws as many channels as there are.  Channels are numbered over
    ranges of their hash, so numbering needs no global sort.  Every channel opens
    one draw per repeat; a draw is a hash, hence the same on every run and in
    every engine.
    """
    clusters = cluster_counts(df, key, label, score, threshold)
    order = [F.substring(F.md5("_key"), 1, 3).asc_nulls_last(), F.col("_key").asc_nulls_last()]
    # read by the draws and by the join
    numbered = materialize(positions(clusters, [], order, "_index", "_total"), "clusters")
    sums = (
        opened_draws(numbered, repeats, seed)
        .join(numbered.select("_index", "tp", "fp", "fn"), "_index")
        .groupBy("repeat")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "repeat",
        S.ratio(tp, tp + fp).alias("precision"),
        S.ratio(tp, tp + fn).alias("recall"),
        S.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def cluster_bootstrap(
    df: DataFrame,
    key: str,
    label: str,
    score: str,
    threshold: float,
    repeats: int = 400,
    seed: int = 2026,
) -> DataFrame:
    """95 % intervals of precision, recall and F1 under resampled channels."""
    draws = bootstrap_draws(df, key, label, score, threshold, repeats, seed)
    long = draws.unpivot("repeat", ["precision", "recall", "f1"], "metric", "value")
    # One value per repeat, so the exact percentile holds a few hundred numbers.
    return long.groupBy("metric").agg(
        F.percentile("value", 0.025).alias("low_95"), F.percentile("value", 0.975).alias("high_95")
    )


def logit(score: Column) -> Column:
    p = clipped(score)
    return F.ln(p / (1 - p))


def fit_calibration(df: DataFrame, label: str, score: str, penalty: float = 10.0) -> dict:
    """Slope and intercept on the log-odds of the scored rows, fitted by Spark ML.

    A slope that would turn the order of the scores round is not used: the
    calibration then changes nothing.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    odds = df.where(scored(F.col(score))).select(logit(F.col(score)).alias("odds"), F.col(label).cast("double").alias("label"))
    table = VectorAssembler(inputCols=["odds"], outputCol="features").transform(odds)
    # the penalty is that of a sum of losses; Spark ML averages them
    learner = LogisticRegression(maxIter=200, regParam=1.0 / (penalty * table.count()), standardization=False)
    model = learner.fit(table)
    slope, intercept = float(model.coefficients[0]), float(model.intercept)
    kept = slope > 0
    return {"coef": slope if kept else 1.0, "intercept": intercept if kept else 0.0, "method": "sigmoid" if kept else "identity"}


def apply_calibration(score: Column, calibration: dict) -> Column:
    """Calibrated probability; a missing score stays missing."""
    odds = F.lit(calibration["intercept"]) + F.lit(calibration["coef"]) * logit(score)
    return F.when(scored(score), 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-50.0)), F.lit(50.0)))))


def lead_times(df: DataFrame, label: str, start: str) -> DataFrame:
    """Hours from prediction to the labelled start, and how many break the bounds."""
    hours = S.hours_between(F.col(start), F.col("prediction_time"))
    positive = df.where(F.col(label) == 1).withColumn("_hours", hours)
    counts = positive.agg(
        F.count("_hours").alias("rows"),
        F.avg("_hours").alias("mean_hours"),
        F.min("_hours").alias("min_hours"),
        F.max("_hours").alias("max_hours"),
        S.count_if((F.col("_hours") < 24) | (F.col("_hours") >= 744)).alias("out_of_bounds"),
    )
    return with_quantiles(counts, positive, [], "_hours", {"median_hours": 0.5})


def early_share(df: DataFrame, label: str, score: str, threshold: float, early: str) -> DataFrame:
    """Share of true alerts that also had a start in the first 24 hours."""
    true_alert = df.where((F.col(label) == 1) & (F.col(score) >= F.lit(float(threshold))))
    hit = F.when(F.col(early) == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    return true_alert.agg(F.count("*").alias("true_alerts"), F.avg(hit).alias("early_share"))


def errors(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Rows where the alert and the label disagree."""
    alert = F.col(score) >= F.lit(float(threshold))
    marked = df.withColumn("alert", alert)
    return marked.where(F.col("alert") != (F.col(label) == 1))


def alert_load(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Alerts and false alerts per prediction date."""
    alert = F.col(score) >= F.lit(float(threshold))
    return df.groupBy("prediction_time").agg(
        S.count_if(alert).alias("alerts"),
        S.count_if(alert & (F.col(label) == 0)).alias("false_alerts"),
    )


def fold_summary(curve_by_fold: DataFrame, pooled: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean and spread of AP over folds next to AP of all folds pooled.

    ``curve_by_fold`` and ``pooled`` are precision-recall curves, the first one
    computed per fold.
    """
    per_fold = ranking_metrics(curve_by_fold, [fold])
    spread = per_fold.agg(
        F.count(fold).alias("folds"),
        F.avg("average_precision").alias("cv_pr_auc_mean"),
        F.coalesce(F.stddev_samp("average_precision"), F.lit(0.0)).alias("cv_pr_auc_std"),
    ).withColumn("_one", F.lit(1))
    whole = ranking_metrics(pooled).select(
        F.col("average_precision").alias("oof_pr_auc"), F.lit(1).alias("_one")
    )
    return spread.join(whole, "_one").drop("_one")
