"""Queries: the checks on rows that break their rules, repair and refresh of single partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators import quality as Q
from vigil.plans import bindings as B
from vigil.plans.queries_journal import _ORDER_DAILY, _order_daily, _plans
from vigil.plans.registry import part, query
from vigil.session import materialize, scratch_path
from vigil.sources import tables as T

LABEL = "target_fault_24_48h"

#: Panel rows with a fault of every kind, as (column, condition, value in its place) for both engines.
_FAULTS = [
    ("feature_max_ts", "events_1d = 2", "prediction_time"),
    ("feature_max_ts", "events_1d = 3", "NULL"),
    ("last_state_ts", "events_7d = 3", "prediction_time + INTERVAL 1 HOUR"),
    ("last_explicit_state", "events_7d IN (2, 15)", "'lost'"),
    (LABEL, f"day(prediction_time) = 12 AND {LABEL} IS NOT NULL", "2"),
    ("events_30d", "events_7d = 4", "3"),
    ("numeric_n_1d", "numeric_n_1d = 1", "0"),
    ("target_start", "day(prediction_time) = 13", "prediction_time"),
    ("at_risk_with_history", "day(prediction_time) = 14", "false"),
    ("global_complete_24_48h", "day(prediction_time) = 15", "NULL"),
    ("channel_id", "events_7d = 6", "NULL"),
]
_COPIED = "day(prediction_time) = 16"


def _cells() -> dict[str, str]:
    cells = {}
    for column in dict.fromkeys(c for c, _, _ in _FAULTS):
        cases = " ".join(f"WHEN {when} THEN {value}" for c, when, value in _FAULTS if c == column)
        cells[column] = f"CASE {cases} ELSE {column} END"
    return cells


part(
    "faulty_panel_t",
    f"""SELECT * REPLACE ({', '.join(f'{sql} AS {name}' for name, sql in _cells().items())})
        FROM (SELECT * FROM panel_t UNION ALL SELECT * FROM panel_t WHERE {_COPIED})""",
)


def _faulty_panel(spark, sf):
    panel = B.panel(spark, sf)
    rows = panel.unionByName(panel.where(_COPIED))
    types = dict(panel.dtypes)
    return rows.withColumns({name: F.expr(sql).cast(types[name]) for name, sql in _cells().items()})


@query(
    "panel_structure_faults",
    f"""SELECT count(*) AS rows, count(*) - count(DISTINCT (channel_id, prediction_time)) AS duplicate_keys,
       count(*) FILTER (WHERE feature_max_ts >= prediction_time) AS future_features,
       count(*) FILTER (WHERE last_state_ts >= prediction_time) AS future_state,
       count(*) FILTER (WHERE {LABEL} NOT IN (0, 1)) AS invalid_labels,
       count(*) FILTER (WHERE events_30d < events_7d OR events_7d < events_1d OR events_1d < 0) AS invalid_counts,
       count(*) FILTER (WHERE numeric_n_1d = 0 AND coalesce(numeric_mean_1d, numeric_std_1d, numeric_min_1d,
         numeric_max_1d) IS NOT NULL) AS numbers_without_measurements FROM faulty_panel_t""",
)
def _(spark, sf):
    return Q.structure_checks(_faulty_panel(spark, sf))


@query(
    "leakage_faults",
    """SELECT count(*) FILTER (WHERE feature_max_ts >= prediction_time) AS future_feature_max_ts,
       count(*) FILTER (WHERE last_state_ts >= prediction_time) AS future_last_state_ts FROM faulty_panel_t""",
)
def _(spark, sf):
    return Q.leakage(_faulty_panel(spark, sf), ["feature_max_ts", "last_state_ts"])


_WEIGHTS = {
    "sampling_probability": "CASE WHEN events_1d = 0 THEN 0.05D WHEN events_1d = 4 THEN 0D ELSE 1D END",
    "sample_weight": "CASE WHEN events_1d = 0 THEN 20D WHEN events_1d = 5 THEN 3D WHEN events_1d = 6 THEN NULL ELSE 1D END",
}
part(
    "faulty_weights_t",
    """SELECT *, CASE events_1d WHEN 0 THEN 0.05 WHEN 4 THEN 0 ELSE 1 END::DOUBLE AS sampling_probability,
       CASE events_1d WHEN 0 THEN 20 WHEN 5 THEN 3 WHEN 6 THEN NULL ELSE 1 END::DOUBLE AS sample_weight
       FROM faulty_panel_t""",
)
_BAD_WEIGHT = "sampling_probability = 0 OR sample_weight IS NULL OR abs(sample_weight * sampling_probability - 1) > 1e-5"


def _weighted(spark, sf):
    return _faulty_panel(spark, sf).withColumns({name: F.expr(sql) for name, sql in _WEIGHTS.items()})


@query(
    "weight_faults",
    f"SELECT count(*) AS rows, count(*) FILTER (WHERE {_BAD_WEIGHT}) AS invalid_weights FROM faulty_weights_t",
)
def _(spark, sf):
    return Q.weight_check(_weighted(spark, sf))


def _audit_sql(name: str, where: str, weighted: bool, scoring: bool = False) -> str:
    def failing(condition: str, applies: bool = True) -> str:
        return f"count(*) FILTER (WHERE {condition})" if applies else "0::BIGINT"

    labelled = not scoring
    checks = {
        "future_features": failing("feature_max_ts IS NULL OR feature_max_ts >= prediction_time"),
        "invalid_eligible_state": failing(
            f"at_risk_with_history AND last_explicit_state IS DISTINCT FROM '{B.WORDS.normal}'"
        ),
        "missing_keys": failing("channel_id IS NULL"),
        "wrong_window": failing(
            "target_start <> prediction_time + INTERVAL 24 HOUR OR target_end <> prediction_time + INTERVAL 48 HOUR", labelled
        ),
        "ineligible": failing("at_risk_with_history IS DISTINCT FROM true", labelled),
        "incomplete": failing("coalesce(channel_followup_48h AND global_complete_24_48h, false) = false", labelled),
        "invalid_labels": failing(f"coalesce({LABEL} NOT IN (0, 1), true)", labelled),
        "positives": f"coalesce(sum({LABEL}), 0)::BIGINT" if labelled else "0::BIGINT",
        "invalid_weights": failing(_BAD_WEIGHT, weighted),
    }
    cells = ", ".join(f"{sql} AS {check}" for check, sql in checks.items())
    return f"""SELECT '{name}' AS split, count(*) AS rows, min(prediction_time) AS first_time,
        max(prediction_time) AS last_time, count(DISTINCT channel_id) AS channels,
        count(*) - count(DISTINCT (channel_id, prediction_time)) AS duplicate_keys, {cells}
        FROM faulty_weights_t WHERE {where}"""


_AUDITED = {
    "train_compact": ("day(prediction_time) < 20", True, False),
    "validation": ("day(prediction_time) >= 10", False, False),
    "scoring_latest": ("prediction_time = (SELECT max(prediction_time) FROM panel_t)", False, True),
}


@query("split_audit_faults", " UNION ALL ".join(_audit_sql(n, *how) for n, how in _AUDITED.items()))
def _(spark, sf):
    rows = _weighted(spark, sf)
    plain = _faulty_panel(spark, sf)
    last = B.panel(spark, sf).agg(F.max("prediction_time").alias("prediction_time"))  # one row
    splits = {
        "train_compact": rows.where("day(prediction_time) < 20"),
        "validation": plain.where("day(prediction_time) >= 10"),
        "scoring_latest": plain.join(F.broadcast(last), "prediction_time", "left_semi"),
    }
    return Q.split_audit(splits, fv.CONTRACT_FEATURES, LABEL, B.WORDS.normal)


@query(
    "state_conflicts_found",
    """SELECT p_brand AS sensor_type, p_size % 5 AS state_set, lower(split_part(p_type, ' ', 1)) AS state,
       count(DISTINCT p_retailprice > 950) AS alarm_variants FROM part GROUP BY ALL
       HAVING count(DISTINCT p_retailprice > 950) > 1""",
)
def _(spark, sf):
    states = B.table(spark, sf, "part").select(
        F.col("p_brand").alias(fv.SENSOR_TYPE),
        (F.col("p_size") % 5).alias(fv.STATE_SET),
        S.normal_text(F.substring_index("p_type", " ", 1)).alias("state"),
        F.when(F.col("p_retailprice") > 950, "true").otherwise("false").alias(fv.STATE_ALARM),
    )
    return Q.state_conflicts(states)


@query(
    "plan_check_faults",
    """SELECT (SELECT count(*) - count(DISTINCT o_custkey) FROM orders) AS repeated_labels,
       (SELECT count(*) FROM orders WHERE trunc(o_totalprice) < 50000) AS start_after_acceptance,
       (SELECT count(*) FROM monthly_plan_t WHERE action NOT IN ('ТО', 'ТР', 'ТО+ТР')) AS unknown_actions,
       (SELECT count(*) FROM orders WHERE o_custkey % 7 = 0) AS quantity_not_numeric""",
)
def _(spark, sf):
    repair, monthly = _plans(spark, sf)
    start = F.to_date("dismantle_start").cast("timestamp_ntz")
    worded = F.when(F.col("source_row") % 7 == 0, F.lit("много")).otherwise(F.col("quantity").cast("string"))
    return Q.plan_checks(repair.withColumn("dismantle_start", start), monthly.withColumn("quantity", worded))


@query(
    "repaired_partitions",
    """SELECT raw_date, count(*) AS rows,
       (right(raw_date, 1) IN ('1', '3', '5', '7', '9') AND count(DISTINCT r) < count(*))::INT AS repaired
       FROM (SELECT raw_date, r FROM raw_journal_t r) GROUP BY 1""",
)
def _(spark, sf):
    """Odd dates lost their copies and are taken from the text, even dates stay as prepared."""
    text = B.raw_journal(spark, sf)
    odd = F.substring("raw_date", -1, 1).isin(*"13579")
    prepared = Q.drop_exact_duplicates(text.where(odd)).unionByName(text.where(~odd))
    fixed, parity = Q.repaired_partitions(prepared, text, ["raw_date"])
    rows = fixed.groupBy("raw_date").agg(F.count("*").alias("rows"))
    return rows.join(parity.select("raw_date", (~F.col("matches")).alias("repaired")), "raw_date")


@query(
    "refreshed_by_fingerprint",
    f"SELECT year, count(*) AS days, sum(events)::BIGINT AS events FROM ({_ORDER_DAILY}) GROUP BY 1",
)
def _(spark, sf):
    """A summary of a partitioned table, made anew for the years whose files changed."""
    source, target = scratch_path(spark, "source"), scratch_path(spark, "summary")
    daily = materialize(_order_daily(spark, sf), "daily")

    def summary(rows):
        return rows.groupBy("year").agg(F.count("*").alias("days"), F.sum("events").alias("events"))

    even = F.col("year") % 2 == 0
    T.write_table(daily.withColumn("events", F.when(even, F.lit(0)).otherwise(F.col("events")).cast("long")), source, ["year"])
    T.write_table(summary(spark.read.parquet(source)), target, ["year"])
    seen = materialize(T.file_inventory(spark, [source]), "manifest")
    T.overwrite_partitions(daily.where(even), source, ["year"])
    changed = T.changed_files(T.file_inventory(spark, [source]), seen)
    stored = spark.read.parquet(source)
    years = stored.select("year", F.col("_metadata.file_name").alias("file")).join(changed, "file", "left_semi")
    fresh = stored.join(years.select("year").distinct(), "year", "left_semi")
    T.overwrite_partitions(materialize(summary(fresh), "fresh"), target, ["year"])
    return spark.read.parquet(target).select("year", "days", "events")


_COUNTED = ("events", "orders", "lineitem", "customer")


@query(
    "file_rows", " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS rows FROM {t}" for t in _COUNTED)
)
def _(spark, sf):
    found = [T.file_rows(B.table(spark, sf, t)) for t in _COUNTED]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole
