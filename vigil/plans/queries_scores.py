"""Queries: evaluation of scored rows and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import evaluate as E
from vigil.operators import model as M
from vigil.operators import splits as SP
from vigil.plans import bindings as B
from vigil.plans.queries_panel import monthly, rounded
from vigil.plans.queries_splits import FOLD_START, yearly
from vigil.plans.registry import part, query
from vigil.session import scratch_path

LEVEL = 0.45
Y, P = "label", "probability"


def _curve_sql(source: str, weight: str = "1", by: str = "") -> str:
    keys = f"{by}, " if by else ""
    same = f"AND b.{by} IS NOT DISTINCT FROM a.{by}" if by else ""
    group = f"WHERE {by} IS NOT DISTINCT FROM a.{by}" if by else ""
    return f"""SELECT *, ctp / cn AS precision, ctp / nullif(positives, 0) AS recall,
         coalesce(2 * (ctp / cn) * (ctp / nullif(positives, 0)) / nullif(ctp / cn + ctp / nullif(positives, 0), 0), 0) AS f1,
         5 * (ctp / cn) * (ctp / nullif(positives, 0)) / (4 * (ctp / cn) + ctp / nullif(positives, 0) + 1e-12) AS f2
       FROM (SELECT {keys} threshold, tp, n,
               sum(tp) OVER (PARTITION BY {by or '1'} ORDER BY threshold DESC) AS ctp,
               sum(n) OVER (PARTITION BY {by or '1'} ORDER BY threshold DESC) AS cn,
               sum(tp) OVER (PARTITION BY {by or '1'}) AS positives, sum(n) OVER (PARTITION BY {by or '1'}) AS total
             FROM (SELECT {keys} probability AS threshold, sum({weight} * label) AS tp, sum({weight}) AS n
                   FROM {source} GROUP BY ALL))"""


part("curve_t", _curve_sql("scored_t"))
part("weighted_curve_t", _curve_sql("scored_t", "weight"))
part("kind_curve_t", _curve_sql("scored_t", "1", "kind"))
part("month_curve_t", _curve_sql("scored_t", "1", "month"))


@query(
    "threshold_table",
    """SELECT threshold, n::BIGINT AS n, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(f1, 9) AS f1, round(f2, 9) AS f2 FROM curve_t""",
)
def _(spark, sf):
    curve = E.pr_curve(B.scored(spark, sf), Y, P)
    out = curve.select("threshold", "n", "precision", "recall", "f1", "f2")
    return rounded(out, ["precision", "recall", "f1", "f2"], 9)


_RANK = """round(sum(tp / nullif(positives, 0) * precision), 9) AS average_precision,
   round(sum((n - tp) * (ctp - tp / 2)) / nullif(max(positives) * (max(total) - max(positives)), 0), 9) AS roc_auc"""


@query(
    "ranking_metrics",
    """SELECT round((SELECT sum(tp / positives * precision) FROM curve_t), 9) AS average_precision,
       round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) *
         (count(*) FILTER (WHERE label = 1) + 1) / 2) /
         (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 9) AS roc_auc
       FROM (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2 AS r
             FROM scored_t)""",
)
def _(spark, sf):
    found = E.ranking_metrics(E.pr_curve(B.scored(spark, sf), Y, P))
    return rounded(found, ["average_precision", "roc_auc"], 9)


@query("weighted_ranking_metrics", f"SELECT {_RANK} FROM weighted_curve_t")
def _(spark, sf):
    found = E.ranking_metrics(E.pr_curve(B.scored(spark, sf), Y, P, "weight"))
    return rounded(found, ["average_precision", "roc_auc"], 9)


def _best_sql(policy: str, where: str) -> str:
    quality = {"joint_f1": "f1 DESC, precision DESC, recall DESC", "joint_recall": "recall DESC", "f2": "f2 DESC"}
    ok = "(precision > 0.7 AND recall > 0.5)"
    first = {"joint_f1": f"{ok} DESC, {quality['joint_f1']}", "f2": quality["f2"]}.get(
        policy, f"{ok} DESC, if({ok}, recall, f1) DESC"
    )
    return f"""SELECT '{policy}' AS policy, threshold, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(f1, 9) AS f1, round(f2, 9) AS f2, {ok}::INT AS feasible FROM
       (SELECT * FROM {where} ORDER BY {first}, threshold LIMIT 1)"""


_POLICIES = ("joint_f1", "joint_recall", "f2")


@query("threshold_policies", " UNION ALL ".join(_best_sql(p, "curve_t") for p in _POLICIES))
def _(spark, sf):
    curve = E.pr_curve(B.scored(spark, sf), Y, P)
    found = None
    for policy in _POLICIES:
        one = E.select_threshold(curve, policy).withColumn("policy", F.lit(policy))
        found = one if found is None else found.unionByName(one)
    return rounded(found, ["precision", "recall", "f1", "f2"], 9)


@query("weighted_threshold_policy", _best_sql("joint_recall", "weighted_curve_t"))
def _(spark, sf):
    curve = E.pr_curve(B.scored(spark, sf), Y, P, "weight")
    found = E.select_threshold(curve, "joint_recall").withColumn("policy", F.lit("joint_recall"))
    return rounded(found, ["precision", "recall", "f1", "f2"], 9)


@query(
    "candidate_summary",
    """SELECT round(sum(tp / positives * precision), 9) AS average_precision,
       round(coalesce(max(recall) FILTER (WHERE precision > 0.7), 0), 9) AS recall_at_precision_gt_07,
       round(coalesce(max(precision) FILTER (WHERE recall > 0.5), 0), 9) AS precision_at_recall_gt_05,
       bool_or(precision > 0.7 AND recall > 0.5)::INT AS feasible, round(max(f1), 9) AS max_f1 FROM curve_t""",
)
def _(spark, sf):
    found = E.candidate_summary(E.pr_curve(B.scored(spark, sf), Y, P))
    names = ["average_precision", "recall_at_precision_gt_07", "precision_at_recall_gt_05", "max_f1"]
    return rounded(found, names, 9)


def _at_sql(keys: str, weight: str = "1") -> str:
    select = f"{keys}, " if keys else ""
    alert = f"probability >= {LEVEL}"

    def w(condition: str) -> str:
        return f"coalesce(sum({weight}) FILTER (WHERE {condition}), 0)"

    tp, fp, fn = (
        w(f"{alert} AND label = 1"),
        w(f"{alert} AND label = 0"),
        w(f"NOT {alert} AND label = 1"),
    )
    return f"""SELECT {select} count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives, {LEVEL}::DOUBLE AS threshold,
       count(*) FILTER (WHERE {alert}) AS alerts, count(*) FILTER (WHERE {alert} AND label = 1) AS tp,
       count(*) FILTER (WHERE {alert} AND label = 0) AS fp, count(*) FILTER (WHERE NOT {alert} AND label = 1) AS fn,
       count(*) FILTER (WHERE NOT {alert} AND label = 0) AS tn,
       round(sum({weight} * label) / sum({weight}), 9) AS prevalence,
       round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 9) AS precision,
       round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 9) AS recall,
       round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 9) AS f1,
       round(coalesce(5 * {tp} / nullif(5 * {tp} + {fp} + 4 * {fn}, 0), 0), 9) AS f2,
       round(1000 * count(*) FILTER (WHERE {alert}) / count(*), 6) AS alerts_per_1000 FROM scored_t GROUP BY ALL"""


_RATES = ["prevalence", "precision", "recall", "f1", "f2"]


def _rates(df):
    return rounded(rounded(df, _RATES, 9), ["alerts_per_1000"], 6)


@query("threshold_metrics", _at_sql(""))
def _(spark, sf):
    return _rates(E.threshold_metrics(B.scored(spark, sf), Y, P, LEVEL))


@query("weighted_threshold_metrics", _at_sql("", "weight"))
def _(spark, sf):
    return _rates(E.threshold_metrics(B.scored(spark, sf), Y, P, LEVEL, "weight"))


def _group_sql(key: str, curve: str) -> str:
    return f"""SELECT * FROM ({_at_sql(key)}) JOIN (SELECT {key}, {_RANK} FROM {curve} GROUP BY 1) USING ({key})"""


@query("metrics_by_month", _group_sql("month", "month_curve_t"))
def _(spark, sf):
    found = E.metrics(B.scored(spark, sf), Y, P, LEVEL, by=["month"])
    return rounded(_rates(found), ["average_precision", "roc_auc"], 9)


@query("metrics_by_kind", _group_sql("kind", "kind_curve_t"))
def _(spark, sf):
    found = E.metrics(B.scored(spark, sf), Y, P, LEVEL, by=["kind"])
    return rounded(_rates(found), ["average_precision", "roc_auc"], 9)


_GRID = [0.0025, 0.005, 0.01, 0.02, 0.05, 0.3]


@query(
    "threshold_grid",
    " UNION ALL ".join(
        f"""SELECT threshold, {int(t == LEVEL)} AS is_optimum, tp, fp, fn, tn, precision, recall, f2 FROM
            ({_at_sql('').replace(str(LEVEL), repr(t))})"""
        for t in [*_GRID, LEVEL]
    ),
)
def _(spark, sf):
    found = E.threshold_grid(B.scored(spark, sf), Y, P, _GRID, LEVEL)
    return rounded(found, ["precision", "recall", "f2"], 9)


@query(
    "probability_metrics",
    """SELECT kind, round(avg((p - label) ** 2), 9) AS brier, round(-avg(if(label = 1, ln(p), ln(1 - p))), 9) AS log_loss
       FROM (SELECT *, greatest(least(probability, 1 - 1e-8), 1e-8) AS p FROM scored_t) GROUP BY 1""",
)
def _(spark, sf):
    found = E.probability_metrics(B.scored(spark, sf), Y, P, by=["kind"])
    return rounded(found, ["brier", "log_loss"], 9)


@query(
    "reliability",
    """SELECT bin, count(*) AS rows, round(avg(probability), 9) AS mean_probability, round(avg(label), 9) AS event_rate
       FROM (SELECT s.*, (SELECT count(*) FROM (SELECT DISTINCT unnest(
               (SELECT quantile_cont(probability, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM scored_t)) AS e)
               WHERE e < s.probability)::INT AS bin FROM scored_t s) GROUP BY 1""",
)
def _(spark, sf):
    found = E.reliability(B.scored(spark, sf), Y, P, 10)
    return rounded(found, ["mean_probability", "event_rate"], 9)


part(
    "clusters_t",
    f"""SELECT *, row_number() OVER (ORDER BY md5(channel_id)[1:3], channel_id) - 1 AS i FROM
        (SELECT channel_id, count(*) FILTER (WHERE probability >= {LEVEL} AND label = 1) AS tp,
           count(*) FILTER (WHERE probability >= {LEVEL} AND label = 0) AS fp,
           count(*) FILTER (WHERE probability < {LEVEL} AND label = 1) AS fn FROM scored_t GROUP BY 1)""",
)
part(
    "draws_t",
    """SELECT repeat, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM
       (SELECT r::INT AS repeat, ('0x' || md5('2026|' || r::VARCHAR || '|' || i::VARCHAR)[1:12])::BIGINT
          % (SELECT count(*) FROM clusters_t) AS j FROM clusters_t, range(1, 401) x(r))
       JOIN clusters_t ON i = j GROUP BY 1""",
)


@query(
    "bootstrap_draws",
    """SELECT repeat, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall,
       round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM draws_t""",
)
def _(spark, sf):
    draws = E.bootstrap_draws(B.scored(spark, sf), "channel_id", Y, P, LEVEL)
    return rounded(draws, ["precision", "recall", "f1"], 9)


@query(
    "cluster_intervals",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, round(quantile_cont(v, 0.025), 9) AS low_95, round(quantile_cont(v, 0.975), 9) AS high_95
            FROM (SELECT {e} AS v FROM draws_t)"""
        for m, e in {
            "precision": "tp / nullif(tp + fp, 0)",
            "recall": "tp / nullif(tp + fn, 0)",
            "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)",
        }.items()
    ),
)
def _(spark, sf):
    found = E.cluster_bootstrap(B.scored(spark, sf), "channel_id", Y, P, LEVEL)
    return rounded(found, ["low_95", "high_95"], 9)


@query(
    "error_table",
    f"""SELECT order_id, line, channel_id, label, probability, (probability >= {LEVEL})::INT AS alert FROM scored_t
        WHERE (probability >= {LEVEL}) <> (label = 1)""",
)
def _(spark, sf):
    found = E.errors(B.scored(spark, sf), Y, P, LEVEL)
    return found.select("order_id", "line", "channel_id", "label", "probability", "alert")


@query(
    "alert_load",
    f"""SELECT prediction_time, count(*) FILTER (WHERE probability >= {LEVEL}) AS alerts,
        count(*) FILTER (WHERE probability >= {LEVEL} AND label = 0) AS false_alerts FROM scored_t GROUP BY 1""",
)
def _(spark, sf):
    return E.alert_load(B.scored(spark, sf), Y, P, LEVEL)


@query(
    "lead_times",
    """SELECT count(h) AS rows, round(avg(h), 6) AS mean_hours, round(min(h), 6) AS min_hours,
       round(quantile_cont(h, 0.5), 6) AS median_hours, round(max(h), 6) AS max_hours,
       count(*) FILTER (WHERE h < 24 OR h >= 744) AS out_of_bounds
       FROM (SELECT date_diff('microsecond', prediction_time, next_start_after_24h) / 3.6e9 AS h FROM monthly_t
             WHERE target_monthly = 1)""",
)
def _(spark, sf):
    found = E.lead_times(monthly(spark, sf), "target_monthly", "next_start_after_24h")
    return rounded(found, ["mean_hours", "min_hours", "median_hours", "max_hours"], 6)


@query(
    "early_share",
    """SELECT count(*) AS true_alerts, round(avg((coalesce(target_fault_0_24h, 0) = 1)::INT), 9) AS early_share FROM monthly_t
       WHERE target_monthly = 1 AND alarms_7d / 20 >= 0.3""",
)
def _(spark, sf):
    rows = monthly(spark, sf).withColumn("p", F.col("alarms_7d") / 20)
    found = E.early_share(rows, "target_monthly", "p", 0.3, "target_fault_0_24h")
    return rounded(found, ["early_share"], 9)


@query(
    "fold_summary",
    f"""SELECT count(*) AS folds, round(avg(ap), 9) AS cv_pr_auc_mean, round(stddev_samp(ap), 9) AS cv_pr_auc_std,
        round((SELECT sum(tp / positives * precision) FROM
          ({_curve_sql("(SELECT * FROM scored_t WHERE year(prediction_time) IN (SELECT fold FROM folds_t)) s")})), 9) AS oof_pr_auc
        FROM (SELECT fold, sum(tp / positives * precision) AS ap FROM
          ({_curve_sql("(SELECT *, year(prediction_time) AS fold FROM scored_t WHERE year(prediction_time) IN (SELECT fold FROM folds_t)) s", "1", "fold")})
        GROUP BY fold)""",
)
def _(spark, sf):
    scored = yearly(spark, sf)
    folds = SP.expanding_folds(scored, SP.fold_years(scored, FOLD_START), FOLD_START)
    held = folds.where(F.col("role") == "validation")
    found = E.fold_summary(E.pr_curve(held, Y, P, by=["fold"]), E.pr_curve(held, Y, P))
    return rounded(found, ["cv_pr_auc_mean", "cv_pr_auc_std", "oof_pr_auc"], 9)


@query(
    "applied_calibration",
    """SELECT order_id, line, channel_id, round(1 / (1 + exp(-greatest(least(ln(p / (1 - p)) * 0.8 + 0.1, 50), -50))), 9)
       AS calibrated FROM (SELECT *, greatest(least(probability, 1 - 1e-8), 1e-8) AS p FROM scored_t)""",
)
def _(spark, sf):
    value = E.apply_calibration(F.col(P), {"coef": 0.8, "intercept": 0.1})
    return B.scored(spark, sf).select(
        "order_id", "line", "channel_id", F.round(value, 9).alias("calibrated")
    )


@query("fitted_calibration")
def _(spark, sf):
    rows = B.scored(spark, sf)
    calibration = E.fit_calibration(rows, Y, P)
    value = E.apply_calibration(F.col(P), calibration)
    return E.probability_metrics(rows.withColumn("calibrated", value), Y, "calibrated", by=["kind"])


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TARGET = "target_monthly"


def _model_rows(spark, sf):
    """Line items as labelled rows: split by year, label from the return flag."""
    lines = B.table(spark, sf, "lineitem")
    year = F.year("l_shipdate")
    split = F.when(year < 1996, "train").when(year < 1997, "validation").otherwise("test")
    loss = F.col("l_discount") * 10 + F.col("l_quantity") / 50
    return lines.select(
        F.col("l_suppkey").cast("string").alias("channel_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("prediction_time"),
        *[F.when(F.col("l_linenumber") != 7, F.col(f)).alias(f) for f in FEATURES],
        F.when((F.col("l_returnflag") != "N") & (loss > 1), 1).otherwise(0).alias(TARGET),
        (F.col("l_linestatus") == "F").alias("eligible"),
        (F.lit(1.0) + F.col("l_tax")).alias("sample_weight"),
        split.alias("split"),
    )


def _splits(spark, sf):
    rows = _model_rows(spark, sf)
    return {s: rows.where(F.col("split") == s) for s in ("train", "validation", "test")}


@query(
    "prior_model",
    """SELECT split, round(avg(p), 9) AS probability, count(*) AS rows FROM
       (SELECT CASE WHEN year(l_shipdate) < 1996 THEN 'train' WHEN year(l_shipdate) < 1997 THEN 'validation'
          ELSE 'test' END AS split, (SELECT sum((1 + l_tax) * if(l_returnflag <> 'N' AND l_discount * 10 + l_quantity / 50 > 1, 1, 0))
          / sum(1 + l_tax) FROM lineitem WHERE year(l_shipdate) < 1996) AS p FROM lineitem) GROUP BY 1""",
)
def _(spark, sf):
    rows = _model_rows(spark, sf)
    fitted = M.fit(rows.where("split = 'train'"), FEATURES, TARGET, "prior", "sample_weight")
    scored = M.probability(rows, fitted)
    return scored.groupBy("split").agg(
        F.round(F.avg("probability"), 9).alias("probability"), F.count("*").alias("rows")
    )


@query("selected_model_scores")
def _(spark, sf):
    chosen, _results = M.fit_select(
        _splits(spark, sf), FEATURES, TARGET, weight="sample_weight", iterations=10, depth=3
    )
    return M.score(_model_rows(spark, sf), chosen).drop("split", "sample_weight")


@query("final_evaluation")
def _(spark, sf):
    splits = _splits(spark, sf)
    fitted = M.fit(splits["train"], FEATURES, TARGET, "logistic", "sample_weight")
    curve = E.pr_curve(M.probability(splits["validation"], fitted), TARGET, "probability")
    fitted.contract.threshold = float(E.select_threshold(curve, "f2").first()["threshold"])
    return M.evaluate_once(splits["test"], fitted, TARGET, allow_test=True)


@query("feature_importance")
def _(spark, sf):
    train = _splits(spark, sf)["train"]
    fitted = M.fit(train, FEATURES, TARGET, "trees", iterations=5, depth=3)
    return M.importance(spark, fitted)


@query("out_of_fold_scores")
def _(spark, sf):
    end = F.col("prediction_time") + F.expr("interval 48 hours")
    rows = _model_rows(spark, sf).withColumn("target_end", end)
    years = SP.fold_years(rows, FOLD_START)
    scored = M.out_of_fold(SP.expanding_folds(rows, years, FOLD_START), years, FEATURES, TARGET)
    return E.ranking_metrics(E.pr_curve(scored, TARGET, "probability", by=["fold"]), ["fold"])


@query(
    "scoring_parity",
    "SELECT count(*) AS rows, 0.0::DOUBLE AS max_difference, 0::BIGINT AS unmatched FROM lineitem",
)
def _(spark, sf):
    """A stored and reloaded model scores every key like the fitted one."""
    lines = _model_rows(spark, sf).drop("split")
    fitted = M.fit(lines, FEATURES, TARGET, "logistic", "sample_weight", iterations=5)
    path = scratch_path(spark, "model")
    M.save(spark, fitted, path)
    # rows that share their key are told apart by their features
    key = ["l_orderkey", "l_linenumber", "l_suppkey", *FEATURES]
    groups = B.table(spark, sf, "lineitem").groupBy(*key).agg(F.count("*").alias("_n"))
    left, right = M.probability(groups, fitted), M.probability(groups, M.load(spark, path, FEATURES))
    gap = M.largest_difference(left, right, key, "probability").withColumn("_k", F.lit(1))
    rows = left.agg(F.sum("_n").alias("rows")).withColumn("_k", F.lit(1))
    return rows.join(gap, "_k").drop("_k")
