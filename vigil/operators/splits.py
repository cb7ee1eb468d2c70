"""Temporal splits, reproducible samples and their checks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators.quality import AuditError

KEY = ["channel_id", "prediction_time"]


def _at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def split_name(validation_start: str, test_start: str) -> Column:
    """train, validation or test; NULL where a target window crosses a border."""
    t, end = F.col("prediction_time"), F.col("target_end")
    first, second = _at(validation_start), _at(test_start)
    return (
        F.when((t < first) & (end <= first), F.lit("train"))
        .when((t >= first) & (t < second) & (end <= second), F.lit("validation"))
        .when(t >= second, F.lit("test"))
    )


def temporal(
    panel: DataFrame,
    label: str,
    validation_start: str,
    test_start: str,
    same_followup: bool = True,
) -> DataFrame:
    """Eligible labelled rows with their split.

    With ``same_followup`` both classes need the same observation afterwards;
    without it a seen positive is enough.
    """
    chosen = panel.where(F.col("at_risk_with_history") & F.col(label).isNotNull())
    if same_followup:
        chosen = chosen.where(F.col("channel_followup_48h") & F.col("global_complete_24_48h"))
    named = chosen.withColumn("split", split_name(validation_start, test_start))
    return named.where(F.col("split").isNotNull())


def excluded_followup(
    panel: DataFrame, label: str, validation_start: str, test_start: str
) -> DataFrame:
    """Rows the follow-up rule removes from the splits, kept for analysis."""
    loose = temporal(panel, label, validation_start, test_start, same_followup=False)
    seen = F.col("channel_followup_48h") & F.col("global_complete_24_48h")
    return loose.where(~F.coalesce(seen, F.lit(False)))


def summary(rows: DataFrame, label: str, by: str = "split") -> DataFrame:
    """Rows, channels, time range, positives and prevalence per split."""
    per_channel = rows.groupBy(by, "channel_id", "object_id_current").agg(
        F.count("*").alias("_n"),
        F.min("prediction_time").alias("_lo"),
        F.max("prediction_time").alias("_hi"),
        F.sum(F.col(label).cast("long")).alias("_pos"),
    )
    return per_channel.groupBy(by).agg(
        F.sum("_n").alias("rows"),
        F.count_distinct("channel_id").alias("channels"),
        F.min("_lo").alias("min_prediction"),
        F.max("_hi").alias("max_prediction"),
        F.sum("_pos").alias("positives"),
        (F.sum("_pos") / F.sum("_n")).alias("prevalence"),
        F.count_distinct("object_id_current").alias("known_objects"),
    )


def eligibility(panel: DataFrame, label: str, by: Column) -> DataFrame:
    """How many panel rows drop out for which reason."""
    risk, given = F.col("at_risk_with_history"), F.col(label).isNotNull()
    return panel.groupBy(by.alias("period")).agg(
        F.count("*").alias("panel_rows"),
        S.count_if(~risk).alias("not_eligible_past"),
        S.count_if(~given).alias("censored_target"),
        S.count_if(risk & given).alias("eligible_before_purge"),
    )


def followup_selection(
    panel: DataFrame, label: str, validation_start: str, test_start: str
) -> DataFrame:
    excluded = excluded_followup(panel, label, validation_start, test_start)
    return excluded.groupBy("split").agg(
        F.count("*").alias("excluded_rows"),
        F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("excluded_positives"),
    )


def compact(
    rows: DataFrame, label: str, modulus: int = 20, seed: int = 2026, key: Sequence[str] = KEY
) -> DataFrame:
    """All positives and every ``modulus``-th negative by the hash of its key."""
    positive = F.col(label) == 1
    bucket = S.hash_bucket([F.col(k) for k in key], modulus, seed)
    return rows.where(positive | (bucket == 0)).withColumns(
        {
            "sampling_probability": F.when(positive, F.lit(1.0)).otherwise(F.lit(1.0 / modulus)),
            "sample_weight": F.when(positive, F.lit(1.0)).otherwise(F.lit(float(modulus))),
        }
    )


def latest_snapshot(panel: DataFrame) -> DataFrame:
    """Rows of the last prediction time there is."""
    # A global aggregate: exactly one row.
    last = F.broadcast(panel.agg(F.max("prediction_time").alias("prediction_time")))
    return panel.join(last, "prediction_time", "left_semi")


def fold_years(rows: DataFrame, train_start: str = "2022-01-01") -> list[int]:
    """Years with predictions from the start on, one fold each; the first has nothing before it to train on."""
    year = F.year("prediction_time")
    found = rows.where(F.col("prediction_time") >= _at(train_start)).select(year.alias("y")).distinct()
    return sorted(r["y"] for r in found.collect())[1:]  # a handful


def expanding_folds(
    rows: DataFrame, years: Sequence[int], train_start: str = "2022-01-01"
) -> DataFrame:
    """Each row once per fold it belongs to, as training or validation row.

    A fold trains on everything from the start whose target window ended before
    its year and validates on that year.  One scan: a row opens its own folds.
    """
    t, end = F.col("prediction_time"), F.col("target_end")
    options = []
    for year in years:
        first, after = _at(f"{year}-01-01"), _at(f"{year + 1}-01-01")
        trains = (t >= _at(train_start)) & (t < first) & (end <= first)
        validates = (t >= first) & (t < after)
        role = F.when(trains, F.lit("train")).when(validates, F.lit("validation"))
        options.append(F.struct(F.lit(year).alias("fold"), role.alias("role")))
    opened = rows.withColumn("_fold", F.explode(F.array(*options))).where("_fold.role IS NOT NULL")
    return opened.withColumns({"fold": F.col("_fold.fold"), "role": F.col("_fold.role")}).drop(
        "_fold"
    )


def roles(rows: DataFrame, borders: Sequence[str], horizon_days: int) -> DataFrame:
    """train / tune / threshold / test by date, purged by the horizon at each border."""
    t = F.col("prediction_time")
    end = t + F.expr(f"interval {horizon_days} days")
    names = ["train", "tune", "threshold", "test"]
    edges = [None, *borders, None]
    role = F.lit(None).cast("string")
    for name, low, high in zip(names, edges, edges[1:]):
        inside = F.lit(True)
        if low:
            inside = inside & (t >= _at(low))
        if high:
            inside = inside & (end <= _at(high))
        role = F.when(inside, F.lit(name)).otherwise(role)
    return rows.withColumn("role", role).where(F.col("role").isNotNull())


def check_roles(rows: DataFrame, horizon_days: int) -> DataFrame:
    """Range of each role; raises when a target window reaches the next role."""
    t = F.col("prediction_time")
    report = rows.groupBy("role").agg(
        F.count("*").alias("rows"),
        F.min(t).alias("first_prediction"),
        F.max(t).alias("last_prediction"),
        F.max(t + F.expr(f"interval {horizon_days} days")).alias("last_target_end"),
    )
    found = {r["role"]: r for r in report.collect()}  # at most four rows
    order = [r for r in ("train", "tune", "threshold", "test") if r in found]
    for left, right in zip(order, order[1:]):
        if found[left]["last_target_end"] > found[right]["first_prediction"]:
            raise AuditError(f"{left}/{right}: target windows overlap")
    return report


def recency_weight(rows: DataFrame, reference: str, weight: str, half_life: int = 180) -> DataFrame:
    """Weight halved every ``half_life`` days of age, scaled to a mean of one."""
    age = F.date_diff(_at(reference).cast("date"), F.to_date("prediction_time"))
    aged = rows.withColumn(
        "_aged", F.col(weight) * F.pow(F.lit(2.0), -age / F.lit(float(half_life)))
    )
    # A global aggregate: exactly one row.
    mean = aged.agg(F.avg("_aged").alias("_mean")).withColumn("_one", F.lit(1))
    joined = aged.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one")
    return joined.withColumn("recency_weight", F.col("_aged") / F.col("_mean")).drop(
        "_aged", "_mean", "_one"
    )


def class_weight(rows: DataFrame, label: str, positive_weight: float) -> DataFrame:
    return rows.withColumn(
        "class_weight",
        F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0)),
    )


def for_direction(
    rows: DataFrame, pattern: str, type_column: str = "sensor_type_current", cap: int | None = None
) -> DataFrame:
    """Rows of one direction; with a cap a reproducible sample of that many."""
    chosen = rows.where(S.matches(F.col(type_column), pattern))
    if cap is None:
        return chosen
    return hash_sample(chosen, cap)


def hash_sample(
    rows: DataFrame,
    n: int,
    seed: int = 42,
    key: Sequence[str] = KEY,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
) -> DataFrame:
    """The ``n`` rows with the smallest hashes (per group): a repeatable sample.

    Rows that share a key are ordered by the columns ``ties``.

    Equal to ordering by the hash and taking the first ``n``, but without one
    task that sees them all: rows are counted per leading hash digits, running
    counts over those few buckets show which buckets are needed, and only there
    are rows numbered, each bucket by itself.
    """
    order = S.row_order([F.col(k) for k in key], seed)
    hashed = rows.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, 4))
    line = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    needed = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(line), F.lit(0)))
        .where(F.col("_before") < n)
        .drop("_n")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_order", *key, *ties)
    numbered = hashed.join(needed, [*by, "_bucket"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(inside)
    )
    return numbered.where(F.col("_rank") <= n).select(*rows.columns)


def class_sample(
    rows: DataFrame, label: str, n: int = 5000, seed: int = 42, key: Sequence[str] = KEY
) -> DataFrame:
    """At most ``n`` rows of each class, by the hash of the key."""
    return hash_sample(rows, n, seed, key, by=[label])


def day_sample(rows: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """A few rows per prediction date for an independent recomputation."""
    order = S.row_order([F.col("channel_id")], seed)
    line = Window.partitionBy("prediction_time").orderBy(order, "channel_id")
    return rows.withColumn("_rank", F.row_number().over(line)).where(F.col("_rank") <= n).drop("_rank")


def key_overlap(left: DataFrame, right: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys present in both of two splits, each counted once."""
    shared = left.select(*key).distinct().join(right.select(*key).distinct(), list(key))
    return shared.agg(F.count("*").alias("overlapping_keys"))


def mark_unseen(rows: DataFrame, train: DataFrame, column: str, name: str) -> DataFrame:
    """Flag of rows whose value training never saw; a NULL value is not flagged."""
    seen = train.select(column).where(F.col(column).isNotNull()).distinct()
    marked = rows.join(seen.withColumn("_seen", F.lit(True)), column, "left")
    return marked.withColumn(name, F.col(column).isNotNull() & F.col("_seen").isNull()).drop("_seen")


def validation_report(splits: dict[str, DataFrame], label: str) -> DataFrame:
    """What ``validate`` judges: one row a split, whatever is wrong with it."""
    parts = []
    for name, df in splits.items():
        keys = df.groupBy("entity_id", "prediction_time").agg(
            F.count("*").alias("_n"),
            S.count_if(F.col(label).isNull()).alias("_null"),
            S.count_if(F.col(label) == 0).alias("_zero"),
            S.count_if(F.col(label) == 1).alias("_one"),
        )
        parts.append(
            keys.agg(
                F.lit(name).alias("split"),
                F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_keys"),
                F.coalesce(F.sum("_null"), F.lit(0)).alias("missing_labels"),
                F.coalesce(F.sum("_zero"), F.lit(0)).alias("negatives"),
                F.coalesce(F.sum("_one"), F.lit(0)).alias("positives"),
                F.min("prediction_time").alias("first_time"),
                F.max("prediction_time").alias("last_time"),
            )
        )
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def validate(splits: dict[str, DataFrame], label: str, horizon_hours: int = 48) -> DataFrame:
    """Both classes, no missing label, unique keys and purged borders; else raises."""
    report = validation_report(splits, label)
    found = {r["split"]: r for r in report.collect()}  # one row per split
    for name, r in found.items():
        if r["missing_labels"] or not r["negatives"] or not r["positives"]:
            raise AuditError(f"{name}: both classes are needed and no label may be missing")
        if r["negatives"] + r["positives"] != r["rows"]:
            raise AuditError(f"{name}: labels other than 0 and 1")
        if r["duplicate_keys"]:
            raise AuditError(f"{name}: repeated keys")
    order = [n for n in ("train", "validation", "test") if n in found]
    for left, right in zip(order, order[1:]):
        reach = found[left]["last_time"] + dt.timedelta(hours=horizon_hours)
        if reach > found[right]["first_time"]:
            raise AuditError(f"{left}/{right}: target windows overlap")
    return report


def route_directions(
    rows: DataFrame, patterns: dict[str, str] = fv.DIRECTION_PATTERNS, column: str = "sensor_type"
) -> DataFrame:
    """Each row once per direction its type matches, in a single scan."""
    options = F.array(
        *[
            F.when(S.matches(F.col(column), pattern), F.lit(name))
            for name, pattern in patterns.items()
        ]
    )
    return rows.withColumn("direction", F.explode(F.array_compact(options)))


def refit_rows(parts: list[DataFrame]) -> DataFrame:
    """Rows of several splits under one another, for the fit on all past data."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
