"""Queries: splits, samples, weights and reports on prepared rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.operators import profile as R
from vigil.operators import quality as Q
from vigil.operators import splits as SP
from vigil.operators.contracts import allowlist
from vigil.operators.panel import DIAGNOSTICS, LABELS, METADATA, panel_feature_names
from vigil.plans import bindings as B
from vigil.plans.queries_panel import monthly, rounded, smoke_panel
from vigil.plans.registry import part, query

LABEL = "target_fault_24_48h"
SMOKE_LABEL = "smoke_signal_24_48h"
VALIDATION, TEST = "2024-01-16", "2024-01-24"
KEYS = "channel_id, prediction_time"


def _split_sql(source: str, label: str, same: bool) -> str:
    seen = "AND channel_followup_48h AND global_complete_24_48h" if same else ""
    return f"""SELECT * FROM (SELECT *, CASE WHEN target_end <= TIMESTAMP '{VALIDATION}' THEN 'train'
         WHEN prediction_time >= TIMESTAMP '{TEST}' THEN 'test'
         WHEN prediction_time >= TIMESTAMP '{VALIDATION}' AND target_end <= TIMESTAMP '{TEST}' THEN 'validation'
         END AS split FROM {source} WHERE at_risk_with_history AND {label} IS NOT NULL {seen}) WHERE split IS NOT NULL"""


part("split_t", _split_sql("panel_t", LABEL, True))
part("loose_split_t", _split_sql("panel_t", LABEL, False))
part("smoke_split_t", _split_sql("smoke_panel_t", SMOKE_LABEL, False))


def split_rows(spark, sf):
    return SP.temporal(B.panel(spark, sf), LABEL, VALIDATION, TEST)


@query("temporal_split", f"SELECT {KEYS}, split, {LABEL} FROM split_t")
def _(spark, sf):
    return split_rows(spark, sf).select("channel_id", "prediction_time", "split", LABEL)


@query("smoke_split", f"SELECT {KEYS}, split, {SMOKE_LABEL} FROM smoke_split_t")
def _(spark, sf):
    rows = SP.temporal(
        smoke_panel(spark, sf), SMOKE_LABEL, VALIDATION, TEST, same_followup=False
    )
    return rows.select("channel_id", "prediction_time", "split", SMOKE_LABEL)


_EXCLUDED = "NOT (channel_followup_48h AND global_complete_24_48h)"


@query("excluded_followup", f"SELECT {KEYS}, split FROM loose_split_t WHERE {_EXCLUDED}")
def _(spark, sf):
    rows = SP.excluded_followup(B.panel(spark, sf), LABEL, VALIDATION, TEST)
    return rows.select("channel_id", "prediction_time", "split")


@query(
    "followup_selection",
    f"""SELECT split, count(*) AS excluded_rows, sum({LABEL})::BIGINT AS excluded_positives
        FROM loose_split_t WHERE {_EXCLUDED} GROUP BY 1""",
)
def _(spark, sf):
    return SP.followup_selection(B.panel(spark, sf), LABEL, VALIDATION, TEST)


@query(
    "split_summary",
    f"""SELECT split, count(*) AS rows, count(DISTINCT channel_id) AS channels, min(prediction_time) AS min_prediction,
        max(prediction_time) AS max_prediction, sum({LABEL})::BIGINT AS positives,
        round(avg({LABEL}), 9) AS prevalence, count(DISTINCT object_id_current) AS known_objects
        FROM split_t GROUP BY 1""",
)
def _(spark, sf):
    return rounded(SP.summary(split_rows(spark, sf), LABEL), ["prevalence"], 9)


@query(
    "panel_eligibility",
    f"""SELECT month(prediction_time) * 100 + week(prediction_time) AS period, count(*) AS panel_rows,
        count(*) FILTER (WHERE NOT at_risk_with_history) AS not_eligible_past,
        count(*) FILTER (WHERE {LABEL} IS NULL) AS censored_target,
        count(*) FILTER (WHERE at_risk_with_history AND {LABEL} IS NOT NULL) AS eligible_before_purge
        FROM panel_t GROUP BY 1""",
)
def _(spark, sf):
    period = F.month("prediction_time") * 100 + F.weekofyear("prediction_time")
    return SP.eligibility(B.panel(spark, sf), LABEL, period.cast("long"))


_BUCKET = (
    "('0x' || substr(md5(concat_ws('|', channel_id, strftime(prediction_time, '%Y-%m-%d %H:%M:%S'), '2026')), 1, 8))"
    "::BIGINT % 20"
)
part(
    "compact_t",
    f"""SELECT *, if({LABEL} = 1, 1.0, 0.05)::DOUBLE AS sampling_probability,
        if({LABEL} = 1, 1.0, 20.0)::DOUBLE AS sample_weight
        FROM split_t WHERE split = 'train' AND ({LABEL} = 1 OR {_BUCKET} = 0)""",
)


def _compact(spark, sf):
    return SP.compact(split_rows(spark, sf).where("split = 'train'"), LABEL)


@query("compact_sample", f"SELECT {KEYS}, {LABEL}, sampling_probability, sample_weight FROM compact_t")
def _(spark, sf):
    columns = ["channel_id", "prediction_time", LABEL, "sampling_probability", "sample_weight"]
    return allowlist(_compact(spark, sf), columns)


@query("weight_check", "SELECT count(*) AS rows, 0::BIGINT AS invalid_weights FROM compact_t")
def _(spark, sf):
    return Q.weight_check(_compact(spark, sf))


@query(
    "refit_rows",
    f"""SELECT split, count(*) AS rows, sum({LABEL})::BIGINT AS positives, sum(w)::DOUBLE AS weight FROM
        (SELECT split, {LABEL}, if({LABEL} = 1, 1, 20) AS w FROM split_t
         WHERE split IN ('train', 'validation') AND ({LABEL} = 1 OR {_BUCKET} = 0)) GROUP BY 1""",
)
def _(spark, sf):
    rows = split_rows(spark, sf)
    parts = [SP.compact(rows.where(F.col("split") == s), LABEL) for s in ("train", "validation")]
    return SP.refit_rows(parts).groupBy("split").agg(
        F.count("*").alias("rows"),
        F.sum(F.col(LABEL).cast("long")).alias("positives"),
        F.sum("sample_weight").alias("weight"),
    )


@query(
    "latest_snapshot",
    f"SELECT {KEYS}, events_30d FROM panel_t WHERE prediction_time = (SELECT max(prediction_time) FROM panel_t)",
)
def _(spark, sf):
    found = SP.latest_snapshot(B.panel(spark, sf))
    return found.select("channel_id", "prediction_time", "events_30d")


def yearly(spark, sf):
    """Scored rows with a target window, for splits over years."""
    rows = B.scored(spark, sf)
    end = F.col("prediction_time") + F.expr("interval 48 hours")
    return rows.withColumn("target_end", end)


FOLD_START = "1993-01-01"
part(
    "folds_t",
    f"""SELECT DISTINCT year(prediction_time)::INT AS fold, make_timestamp(year(prediction_time), 1, 1, 0, 0, 0) AS first_day,
        make_timestamp(year(prediction_time) + 1, 1, 1, 0, 0, 0) AS day_after
        FROM scored_t WHERE year(prediction_time) >
          (SELECT min(year(prediction_time)) FROM scored_t WHERE prediction_time >= TIMESTAMP '{FOLD_START}')""",
)


@query(
    "expanding_folds",
    f"""SELECT fold, if(prediction_time >= first_day, 'validation', 'train') AS role, count(*) AS rows,
        sum(label)::BIGINT AS positives FROM scored_t JOIN folds_t
          ON (prediction_time >= TIMESTAMP '{FOLD_START}' AND prediction_time + INTERVAL 48 HOUR <= first_day)
          OR (prediction_time >= first_day AND prediction_time < day_after)
        GROUP BY ALL""",
)
def _(spark, sf):
    scored = yearly(spark, sf)
    folds = SP.expanding_folds(scored, SP.fold_years(scored, FOLD_START), FOLD_START)
    return folds.groupBy("fold", "role").agg(
        F.count("*").alias("rows"), F.sum("label").alias("positives")
    )


_BORDERS = ("1996-01-01", "1997-01-01", "1998-01-01")


def _roles_sql() -> str:
    edges = [None, *_BORDERS, None]
    names = ("train", "tune", "threshold", "test")
    parts = []
    for name, low, high in zip(names, edges, edges[1:]):
        tests = []
        if low:
            tests.append(f"prediction_time >= TIMESTAMP '{low}'")
        if high:
            tests.append(f"prediction_time + INTERVAL 31 DAY <= TIMESTAMP '{high}'")
        parts.append(
            f"""SELECT '{name}' AS role, count(*) AS rows, min(prediction_time) AS first_prediction,
                max(prediction_time) AS last_prediction,
                max(prediction_time) + INTERVAL 31 DAY AS last_target_end FROM scored_t WHERE {' AND '.join(tests)}"""
        )
    return " UNION ALL ".join(parts)


@query("role_split", _roles_sql())
def _(spark, sf):
    return SP.check_roles(SP.roles(B.scored(spark, sf), _BORDERS, 31), 31)


@query(
    "recency_weight",
    """SELECT year(prediction_time)::INT AS year, count(*) AS rows,
       round(sum(a) / (SELECT avg(weight * 2 ** (date_diff('day', DATE '1999-01-01', prediction_time::DATE) / 180.0))
         FROM scored_t), 3) AS weight
       FROM (SELECT *, weight * 2 ** (date_diff('day', DATE '1999-01-01', prediction_time::DATE) / 180.0) AS a
             FROM scored_t) GROUP BY 1""",
)
def _(spark, sf):
    weighted = SP.recency_weight(B.scored(spark, sf), "1999-01-01", "weight")
    return weighted.groupBy(F.year("prediction_time").alias("year")).agg(
        F.count("*").alias("rows"), F.round(F.sum("recency_weight"), 3).alias("weight")
    )


@query(
    "class_weight",
    "SELECT label, count(*) AS rows, sum(if(label = 1, 3.0, 1.0))::DOUBLE AS weight FROM scored_t GROUP BY 1",
)
def _(spark, sf):
    rows = SP.class_weight(B.scored(spark, sf), "label", 3.0)
    return rows.groupBy("label").agg(
        F.count("*").alias("rows"), F.sum("class_weight").alias("weight")
    )


DIRECTIONS = {"sensor": r"auto|build|house", "infrastructure": r"mach|^furn", "smoke": r"auto"}
part(
    "routed_t",
    " UNION ALL ".join(
        f"SELECT *, '{name}' AS direction FROM channels_t WHERE regexp_matches(lower(sensor_type), '{p}')"
        for name, p in DIRECTIONS.items()
    ),
)


@query(
    "direction_routing",
    "SELECT direction, sensor_type, count(*) AS channels FROM routed_t GROUP BY ALL",
)
def _(spark, sf):
    rows = B.channels(spark, sf).withColumnRenamed(fv.SENSOR_TYPE, "sensor_type")
    routed = SP.route_directions(rows, DIRECTIONS)
    return routed.groupBy("direction", "sensor_type").agg(F.count("*").alias("channels"))


@query(
    "direction_rows",
    f"SELECT {KEYS}, split FROM split_t WHERE regexp_matches(lower(sensor_type_current), 'auto|build|house')",
)
def _(spark, sf):
    rows = SP.for_direction(split_rows(spark, sf), DIRECTIONS["sensor"])
    return rows.select("channel_id", "prediction_time", "split")


_ORDER = "md5(concat_ws('|', order_id::VARCHAR, line::VARCHAR, channel_id, '42'))"
_LINE_KEY = ["order_id", "line", "channel_id"]
_LINE_COLUMNS = "order_id, line, channel_id, label"


@query("hash_sample", f"SELECT {_LINE_COLUMNS} FROM scored_t ORDER BY {_ORDER}, label LIMIT 2500")
def _(spark, sf):
    rows = B.scored(spark, sf).select(*_LINE_KEY, "label")
    return SP.hash_sample(rows, 2500, key=_LINE_KEY, ties=["label"])


@query(
    "class_sample",
    f"SELECT {_LINE_COLUMNS} FROM scored_t QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_ORDER}) <= 5000",
)
def _(spark, sf):
    # rows of one class and key are alike in these columns
    return SP.class_sample(B.scored(spark, sf).select(*_LINE_KEY, "label"), "label", 5000, key=_LINE_KEY)


@query(
    "day_sample",
    f"""SELECT {KEYS} FROM (SELECT {KEYS}, (SELECT count(*) FROM panel_t o WHERE o.prediction_time = p.prediction_time
          AND md5(o.channel_id || '|42') < md5(p.channel_id || '|42')) AS before FROM panel_t p) WHERE before < 3""",
)
def _(spark, sf):
    return SP.day_sample(B.panel(spark, sf).select("channel_id", "prediction_time"))


@query(
    "key_overlap",
    """SELECT count(*) AS overlapping_keys FROM (SELECT DISTINCT channel_id FROM split_t WHERE split = 'train')
       JOIN (SELECT DISTINCT channel_id FROM split_t WHERE split = 'test') USING (channel_id)""",
)
def _(spark, sf):
    rows = split_rows(spark, sf)
    halves = [rows.where(F.col("split") == s) for s in ("train", "test")]
    return SP.key_overlap(*halves, key=["channel_id"])


@query(
    "key_overlap_composite",
    """SELECT count(*) AS overlapping_keys FROM
         (SELECT channel_id, line, kind FROM scored_t WHERE prediction_time < TIMESTAMP '1997-01-01'
          INTERSECT SELECT channel_id, line, kind FROM scored_t WHERE prediction_time >= TIMESTAMP '1997-01-01')""",
)
def _(spark, sf):
    rows, early = B.scored(spark, sf), F.col("prediction_time") < F.lit("1997-01-01").cast("timestamp_ntz")
    return SP.key_overlap(rows.where(early), rows.where(~early), key=["channel_id", "line", "kind"])


@query(
    "holdout_drift",
    f"""SELECT split, count(*) AS rows,
        count(*) FILTER (WHERE channel_id NOT IN (SELECT channel_id FROM split_t WHERE split = 'train')) AS new_channel_rows,
        count(*) FILTER (WHERE object_id_current NOT IN (SELECT object_id_current FROM split_t
          WHERE split = 'train' AND object_id_current IS NOT NULL)) AS new_object_rows,
        round(avg(events_7d), 9) AS mean_events_7d, round(avg(alarms_7d), 9) AS mean_alarms_7d,
        round(avg({LABEL}), 9) AS prevalence FROM split_t WHERE split <> 'train' GROUP BY 1""",
)
def _(spark, sf):
    rows = split_rows(spark, sf)
    train, held = rows.where("split = 'train'"), rows.where("split <> 'train'")
    marked = SP.mark_unseen(held, train, "channel_id", "new_channel")
    marked = SP.mark_unseen(marked, train, "object_id_current", "new_object")
    found = R.drift(marked, LABEL)
    return rounded(found, ["mean_events_7d", "mean_alarms_7d", "prevalence"], 9)


@query(
    "target_by_type",
    f"""SELECT split, sensor_type_current, count(*) AS rows, sum({LABEL})::BIGINT AS positives,
        round(avg({LABEL}), 9) AS prevalence FROM split_t GROUP BY ALL""",
)
def _(spark, sf):
    found = R.target_rate(split_rows(spark, sf), LABEL, ["split", "sensor_type_current"])
    return rounded(found, ["prevalence"], 9)


_HYPOTHESES = ["fault_messages_30d", "undefined_messages_7d", "power_messages_7d", "alarms_7d"]


@query(
    "hypotheses",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, ({f} > 0)::INT AS present, count(*) AS rows, count(DISTINCT channel_id) AS channels,
            sum({LABEL})::BIGINT AS positives, round(avg({LABEL}), 9) AS target_rate FROM split_t
            WHERE split = 'train' GROUP BY ({f} > 0)"""
        for f in _HYPOTHESES
    ),
)
def _(spark, sf):
    train = split_rows(spark, sf).where("split = 'train'")
    return rounded(R.hypotheses(train, LABEL, _HYPOTHESES), ["target_rate"], 9)


@query(
    "positive_concentration",
    f"SELECT channel_id, count(*) AS examples, sum({LABEL})::BIGINT AS positives FROM split_t GROUP BY 1",
)
def _(spark, sf):
    return R.concentration(split_rows(spark, sf), LABEL)


@query(
    "top_positive_share",
    f"""SELECT round((SELECT sum(n) FROM (SELECT sum({LABEL}) AS n FROM split_t GROUP BY channel_id ORDER BY n DESC LIMIT 10))
        / sum({LABEL}), 9) AS top_share FROM split_t""",
)
def _(spark, sf):
    return rounded(R.top_share(R.concentration(split_rows(spark, sf), LABEL)), ["top_share"], 9)


def _split_set(spark, sf):
    panel = B.panel(spark, sf)
    rows = SP.temporal(panel, LABEL, VALIDATION, TEST)
    named = {s: rows.where(F.col("split") == s) for s in ("validation", "test")}
    compact = SP.compact(rows.where("split = 'train'"), LABEL)
    return {"train_compact": compact, **named, "scoring_latest": SP.latest_snapshot(panel)}


def _audit_sql(name: str, source: str, scoring: bool) -> str:
    positives = "0::BIGINT" if scoring else f"sum({LABEL})::BIGINT"
    zeros = ", ".join(
        f"0::BIGINT AS {c}"
        for c in (
            "future_features",
            "invalid_eligible_state",
            "missing_keys",
            "wrong_window",
            "ineligible",
            "incomplete",
            "invalid_labels",
            "invalid_weights",
        )
    )
    return f"""SELECT '{name}' AS split, count(*) AS rows, min(prediction_time) AS first_time,
        max(prediction_time) AS last_time, count(DISTINCT channel_id) AS channels,
        count(*) - count(DISTINCT ({KEYS})) AS duplicate_keys, {zeros}, {positives} AS positives FROM {source}"""


@query(
    "split_audit",
    " UNION ALL ".join(
        [
            _audit_sql("train_compact", "compact_t", False),
            _audit_sql("validation", "split_t WHERE split = 'validation'", False),
            _audit_sql("test", "split_t WHERE split = 'test'", False),
            _audit_sql(
                "scoring_latest",
                "panel_t WHERE prediction_time = (SELECT max(prediction_time) FROM panel_t)",
                True,
            ),
        ]
    ),
)
def _(spark, sf):
    return Q.split_audit(_split_set(spark, sf), fv.CONTRACT_FEATURES, LABEL, B.WORDS.normal)


@query(
    "split_validation",
    f"""SELECT split, count(*) AS rows, count(*) - count(DISTINCT (channel_id, prediction_time)) AS duplicate_keys,
        count(*) FILTER (WHERE {LABEL} IS NULL) AS missing_labels,
        count(*) FILTER (WHERE {LABEL} = 0) AS negatives, count(*) FILTER (WHERE {LABEL} = 1) AS positives,
        min(prediction_time) AS first_time, max(prediction_time) AS last_time FROM split_t GROUP BY 1""",
)
def _(spark, sf):
    rows = split_rows(spark, sf).withColumnRenamed("channel_id", "entity_id")
    names = ("train", "validation", "test")
    found = SP.validation_report({s: rows.where(F.col("split") == s) for s in names}, LABEL)
    return found.where("rows > 0")


_PROFILED = ["events_1d", "events_7d", "alarms_7d", "fault_messages_30d", "numeric_mean_7d", "alarm_rate_7d"]


def _profile_sql(f: str) -> str:
    v = f"round({f}, 9)::DOUBLE" if f in ("numeric_mean_7d", "alarm_rate_7d") else f"{f}::DOUBLE"
    return f"""SELECT '{f}' AS feature, count(*) AS rows, count(*) - count({f}) AS missing_or_nonfinite, min({v}) AS min,
        max({v}) AS max, round(avg({v}), 6) AS mean, round(quantile_cont({v}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({v}::DOUBLE, 0.99), 6) AS p99,
        round((count(*) - count({f})) / count(*), 9) AS missing_rate,
        coalesce(min({v}) = max({v}), true)::INT AS constant_or_empty FROM panel_t"""


def _profile_rows(spark, sf):
    return rounded(B.panel(spark, sf), ["numeric_mean_7d", "alarm_rate_7d"], 9)


@query("feature_profile", " UNION ALL ".join(_profile_sql(f) for f in _PROFILED))
def _(spark, sf):
    found = R.feature_profile(_profile_rows(spark, sf), _PROFILED)
    return rounded(rounded(found, ["mean", "median", "p99"], 6), ["missing_rate"], 9)


@query(
    "null_and_constant_features",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, (count({f}) < count(*))::INT AS has_nulls,
            (count(DISTINCT {f}) <= 1)::INT AS is_constant FROM panel_t"""
        for f in [*_PROFILED, "month", "nonfinite_n_1d"]
    ),
)
def _(spark, sf):
    return R.null_and_constant(B.panel(spark, sf), [*_PROFILED, "month", "nonfinite_n_1d"])


_DESCRIBED = {"l_quantity": 6, "l_extendedprice": 2, "l_discount": 6}


@query(
    "value_description",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), {d}) AS mean,
            round(stddev_samp({c}), {d}) AS std, min({c}) AS min, max({c}) AS max, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25,
            round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, round(quantile_cont({c}::DOUBLE, 0.95), 6) AS p95,
            round(quantile_cont({c}::DOUBLE, 0.99), 6) AS p99 FROM lineitem"""
        for c, d in _DESCRIBED.items()
    ),
)
def _(spark, sf):
    found = rounded(R.describe(B.table(spark, sf, "lineitem"), list(_DESCRIBED)), ["p25", "p50", "p75", "p95", "p99"], 6)
    price = F.col("column") == "l_extendedprice"
    return found.withColumns(
        {c: F.when(price, F.round(c, 2)).otherwise(F.round(c, 6)) for c in ("mean", "std")}
    )


@query(
    "outlier_share",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", a AS q1, b AS q3, round(b - a, 6) AS iqr,
            round(100 * (SELECT count(*) FROM lineitem WHERE {c} < a - (b - a) * 1.5 OR {c} > b + (b - a) * 1.5) / n, 9)
            AS outside_percent FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b, count({c}) AS n
            FROM lineitem)"""
        for c in _DESCRIBED
    ),
)
def _(spark, sf):
    found = R.outlier_share(B.table(spark, sf, "lineitem"), list(_DESCRIBED))
    return rounded(rounded(found, ["iqr"], 6), ["outside_percent"], 9)


_RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _spearman_sql() -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _RANKED
    )
    pairs = " UNION ALL ".join(
        f"""SELECT '{a}' AS "left", '{b}' AS "right", round(corr({a}, {b}), 6) AS spearman FROM ranks"""
        for a in _RANKED
        for b in _RANKED
    )
    return f"SELECT * FROM (WITH ranks AS (SELECT {ranks} FROM lineitem) {pairs})"


@query("rank_correlation", _spearman_sql())
def _(spark, sf):
    return rounded(R.spearman(B.table(spark, sf, "lineitem"), _RANKED), ["spearman"], 6)


@query(
    "episode_summary",
    """SELECT year(start_ts)::INT AS year, count(*) AS episodes, count(*) FILTER (WHERE observed_start) AS observed_starts,
       count(DISTINCT channel_id) AS channels, count(*) FILTER (WHERE left_censored) AS left_censored,
       count(*) FILTER (WHERE right_censored) AS right_censored,
       round(quantile_cont(duration_hours, 0.5), 6) AS median_closed_hours FROM order_runs_t GROUP BY 1""",
)
def _(spark, sf):
    return rounded(R.episode_summary(B.order_runs(spark, sf)), ["median_closed_hours"], 6)


@query(
    "duration_sensitivity",
    """SELECT year(start_ts)::INT AS year, count(*) AS episodes, count(duration_hours) AS closed,
       count(*) FILTER (WHERE duration_hours <= 1 / 60) AS closed_at_most_1min,
       count(*) FILTER (WHERE duration_hours >= 5 / 60) AS closed_at_least_5min,
       count(*) FILTER (WHERE duration_hours >= 1) AS closed_at_least_1h FROM runs_t GROUP BY 1""",
)
def _(spark, sf):
    return R.duration_sensitivity(B.fault_runs(spark, sf))


@query(
    "episode_semantics",
    """SELECT c.sensor_type AS sensor_type_current, count(*) AS episodes, count(duration_hours) AS closed_episodes,
       round(avg((duration_hours <= 24)::INT), 9) AS short_share_closed, round(quantile_cont(duration_hours, 0.5), 6) AS median_hours
       FROM runs_t r LEFT JOIN channels_t c ON c.channel_key::VARCHAR = r.channel_id WHERE observed_start GROUP BY 1""",
)
def _(spark, sf):
    found = R.episode_semantics(B.fault_runs(spark, sf), B.metadata(spark, sf), 24.0)
    return rounded(rounded(found, ["short_share_closed"], 9), ["median_hours"], 6)


@query(
    "starts_by_hour",
    "SELECT hour(start_ts)::INT AS hour, count(*) AS starts FROM runs_t WHERE observed_start GROUP BY 1",
)
def _(spark, sf):
    return R.starts_by_hour(B.fault_runs(spark, sf))


@query(
    "duration_histogram",
    """SELECT floor(log10(greatest(duration_hours * 3600, 1)) * 5)::INT AS bin, count(*) AS episodes FROM runs_t
       WHERE duration_hours IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    return R.duration_histogram(B.fault_runs(spark, sf))


@query(
    "top_active_rows",
    f"SELECT {KEYS}, events_30d FROM panel_t ORDER BY events_30d DESC, channel_id, prediction_time LIMIT 10",
)
def _(spark, sf):
    rows = B.panel(spark, sf).select("channel_id", "prediction_time", "events_30d")
    return R.top_rows(rows, "events_30d", 10, "channel_id", "prediction_time")


@query(
    "monthly_rows_by_label",
    "SELECT target_monthly, count(*) AS rows, min(next_start_after_24h) AS first_start FROM monthly_t GROUP BY 1",
)
def _(spark, sf):
    return monthly(spark, sf).groupBy("target_monthly").agg(
        F.count("*").alias("rows"), F.min("next_start_after_24h").alias("first_start")
    )


_TRAINED = f"""target_end <= TIMESTAMP '{VALIDATION}' AND at_risk_with_history AND {LABEL} IS NOT NULL
     AND channel_followup_48h AND global_complete_24_48h"""
_TYPES = "MAP {'VARCHAR': 'string', 'TIMESTAMP': 'timestamp_ntz', 'INTEGER': 'int'}"


def _described_sql() -> str:
    spans = {f"{m}_{w}d": f"{t} за предыдущие {w} суток" for m, t in fv.MEASURE_TEXT.items() for w in fv.PANEL_WINDOWS}
    roles = {c: "feature" for c in panel_feature_names()} | {c: "label" for c in LABELS}
    known = {"feature": fv.KNOWN_BEFORE, "label": fv.KNOWN_LATER, "metadata_or_diagnostic": fv.KNOWN_LATER}
    cells = []
    for c in [*METADATA, *panel_feature_names(), *LABELS, *DIAGNOSTICS]:
        role = roles.get(c, "metadata_or_diagnostic")
        kind = "'tinyint'" if role == "label" else f"coalesce({_TYPES}[any_value(typeof({c}))], lower(any_value(typeof({c}))))"
        used = f"(count(DISTINCT {c}) FILTER (WHERE {_TRAINED}) > 1)::INT" if role == "feature" else "0"
        cells.append(
            f"""{{'column': '{c}', 'role': '{role}', 'dtype': {kind}, 'definition': '{(spans | fv.EXTRA_TEXT | fv.OTHER_TEXT)[c]}',
            'available_at': '{known[role]}', 'use_default': {used}, 'rows': count(*), 'has_nulls': (count({c}) < count(*))::INT,
            'is_constant': (count(DISTINCT {c}) <= 1)::INT}}"""
        )
    return f"SELECT unnest(u) FROM (SELECT unnest([{', '.join(cells)}]) AS u FROM panel_t)"


@query("described_features", _described_sql())
def _(spark, sf):
    return R.feature_dictionary(B.panel(spark, sf), F.expr(_TRAINED.replace("TIMESTAMP", "TIMESTAMP_NTZ")))
