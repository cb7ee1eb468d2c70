"""Journal audits, dictionary audits and checks of prepared rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators import calendar as C
from vigil.operators.contracts import require_columns


class AuditError(ValueError):
    """A check found rows that must not exist."""


def valid_rows(clean: DataFrame) -> DataFrame:
    """Messages with a time and a channel."""
    return clean.where(
        F.col("ts").isNotNull() & F.col("channel_id").isNotNull() & (F.col("channel_id") != "")
    )


def invalid_sample(clean: DataFrame, n: int | None) -> DataFrame:
    """Messages that lack a time, a channel or a readable alarm flag.

    All for n=None, else the n of the smallest row hashes.
    """
    channel = F.col("channel_id")
    lost = F.col("ts").isNull() | channel.isNull() | (channel == "") | F.col("alarm").isNull()
    found = clean.where(lost)
    return found if n is None else found.orderBy(row_hash64(fv.RAW_COLUMNS)).limit(n)


def drop_exact_duplicates(events: DataFrame) -> DataFrame:
    """One row per distinct set of the six raw fields; identifiers are no key."""
    # all other columns follow from these, so whole rows are compared: that needs no sort
    return events.distinct()


def clean_journal(typed_events: DataFrame) -> DataFrame:
    """Journal without exact copies and without rows that cannot be placed."""
    return valid_rows(drop_exact_duplicates(typed_events))


def exact_duplicates(events: DataFrame) -> DataFrame:
    """Raw rows that occur more than once, with their number of copies."""
    groups = events.groupBy(*fv.RAW_COLUMNS).agg(F.count("*").alias("copies"))
    return groups.where(F.col("copies") > 1)


def reused_event_ids(clean: DataFrame) -> DataFrame:
    """Identifiers that name different messages; a finding, not an error."""
    named = clean.where(F.col("event_id").isNotNull() & (F.col("event_id") != ""))
    groups = named.groupBy("event_id").agg(F.count("*").alias("variants"))
    return groups.where(F.col("variants") > 1)


def year_audit(events: DataFrame, year: Column) -> DataFrame:
    """Counts of everything unusual per file year.

    Channels and identifiers are reduced to distinct pairs with the year by
    themselves, so that no row is copied for a second distinct count.
    """
    channel, event = F.col("channel_id"), F.col("event_id")
    dated = events.withColumn("year", year)

    def variety(column: str, name: str) -> DataFrame:
        pairs = dated.where(F.col(column).isNotNull()).select("year", column).distinct()
        return pairs.groupBy(F.col("year").alias("_year")).agg(F.count("*").alias(name))

    counts = dated.groupBy("year").agg(
        F.count("*").alias("rows"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        S.count_if(F.col("alarm")).alias("alarms"),
        S.count_if(F.col("ts").isNull()).alias("bad_ts"),
        S.count_if(F.year("ts") != F.col("year")).alias("wrong_year"),
        S.count_if(F.col("alarm").isNull()).alias("bad_alarm"),
        S.count_if(event.isNull() | (event == "")).alias("missing_event_id"),
        S.count_if(channel.isNull() | (channel == "")).alias("missing_channel_id"),
        S.count_if(channel.isNotNull() & channel.try_cast("long").isNull()).alias("noninteger_channel_id"),
        S.count_if(F.col("sensor_type").isNull()).alias("unknown_channel_rows"),
        S.count_if(F.col("object_id").isNull()).alias("missing_object_rows"),
        S.count_if(F.col("nonfinite")).alias("nonfinite_rows"),
        S.count_if(F.coalesce(F.trim("value_raw"), F.lit("")) == "").alias("missing_value_rows"),
    )
    for column, name in (("channel_id", "channels"), ("event_id", "_events")):
        found = variety(column, name)
        counts = counts.join(found, F.col("year").eqNullSafe(F.col("_year")), "left").drop("_year")
    none = F.lit(0).cast("long")
    repeated = F.col("rows") - F.coalesce("_events", none)
    return counts.withColumns({"channels": F.coalesce("channels", none), "repeated_or_null_event_ids": repeated}).drop("_events")


def row_balance(audit: DataFrame, copies: DataFrame) -> DataFrame:
    """Source rows, exact copies, rows without a time and what is left.

    ``audit`` has a row per year, ``copies`` a row per duplicated raw row.
    """
    totals = audit.agg(
        F.sum("rows").alias("source_rows"),
        F.sum("bad_ts").alias("bad_ts"),
        (F.lit(100.0) * F.sum("unknown_channel_rows") / F.sum("rows")).alias(
            "unknown_channel_percent"
        ),
    )
    extra = copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("exact_copies"))
    both = totals.withColumn("_one", F.lit(1)).join(extra.withColumn("_one", F.lit(1)), "_one")
    return both.drop("_one").withColumn(
        "kept_rows", F.col("source_rows") - F.col("exact_copies") - F.col("bad_ts")
    )


def row_hash64(columns: list[str]) -> Column:
    """Hash of a row that tells where its NULLs are (the hash function alone skips them)."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def signature(raw: DataFrame, columns: list[str] = fv.RAW_COLUMNS, portable: bool = False) -> DataFrame:
    """Row count and a sum of row hashes that does not depend on the order.

    The portable form uses MD5, so that another engine can compute it too.
    """
    if portable:
        text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("~")) for c in columns])
        row_hash = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    else:
        row_hash = row_hash64(columns).cast("decimal(38,0)")
    return raw.agg(F.count("*").alias("rows"), F.sum(row_hash).alias("signature"))


def same_content(left: DataFrame, right: DataFrame, columns: list[str] = fv.RAW_COLUMNS) -> bool:
    return signature(left, columns).first() == signature(right, columns).first()


def repaired_source(prepared: DataFrame, from_text: DataFrame) -> tuple[DataFrame, bool]:
    """The prepared journal where it equals its text source, else the text source."""
    matches = same_content(prepared, from_text)
    return (prepared if matches else from_text), matches


def repaired_partitions(
    prepared: DataFrame, from_text: DataFrame, by: list[str]
) -> tuple[DataFrame, DataFrame]:
    """The prepared journal with only its failing partitions taken from the text, and the first parity.

    The parity of the result is checked once more; a partition that still
    differs is an error.
    """
    parity = source_parity(prepared, from_text, by)
    failing = parity.where(~F.col("matches")).select(*by)
    fixed = prepared.join(failing, by, "left_anti").unionByName(from_text.join(failing, by, "left_semi"))
    if not source_parity(fixed, from_text, by).where(~F.col("matches")).isEmpty():
        raise AuditError("partitions differ from their text after the repair")
    return fixed, parity


def source_parity(prepared: DataFrame, from_text: DataFrame, by: list[str]) -> DataFrame:
    """Parity of two sources per group (usually the year), as a table."""

    def side(df: DataFrame, name: str) -> DataFrame:
        row_hash = row_hash64(fv.RAW_COLUMNS).cast("decimal(38,0)")
        return df.groupBy(*by).agg(
            F.count("*").alias(f"{name}_rows"), F.sum(row_hash).alias(f"_{name}")
        )

    both = side(from_text, "source").join(side(prepared, "prepared"), by, "full")
    equal = F.col("_source").eqNullSafe(F.col("_prepared")) & F.col("source_rows").eqNullSafe(
        F.col("prepared_rows")
    )
    return both.withColumn("matches", equal).drop("_source", "_prepared")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key; a key with NULL counts like any other."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_keys"))


def key_audit(df: DataFrame, key: str, name: str) -> DataFrame:
    """Size of a dictionary and what is wrong with its key."""
    whole = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    per_key = whole.groupBy(key).agg(
        F.sum("_copies").alias("_rows"), F.count("*").alias("_variants")
    )
    return per_key.agg(
        F.lit(name).alias("table"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("extra_duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_rows"))), F.lit(0)).alias(
            "missing_keys"
        ),
        F.coalesce(F.sum(F.col("_rows") - F.col("_variants")), F.lit(0)).alias(
            "extra_exact_duplicates"
        ),
    )


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table itself, after an action that proves its key unique."""
    repeated = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).count()
    if repeated:
        raise AuditError(f"key is not unique: {keys}")
    return df


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that refuses a right side with repeated keys."""
    return left.join(require_unique(right, keys), keys, "left")


def state_conflicts(states: DataFrame) -> DataFrame:
    """Dictionary states with more than one alarm flag in the same set."""
    groups = states.distinct().groupBy(
        F.col(fv.SENSOR_TYPE).alias("sensor_type"), F.col(fv.STATE_SET).alias("state_set"), "state"
    )
    flags = groups.agg(F.count_distinct(fv.STATE_ALARM).alias("alarm_variants"))
    return flags.where(F.col("alarm_variants") > 1)


def state_lookup(states: DataFrame) -> DataFrame:
    """Dictionary by (type, state): number of flags, one flag, number of sets."""
    return (
        states.distinct()
        .groupBy(F.col(fv.SENSOR_TYPE).alias("sensor_type"), "state")
        .agg(
            F.count_distinct(fv.STATE_ALARM).alias("alarm_variants"),
            F.min(fv.STATE_ALARM).alias("dict_alarm"),
            F.count_distinct(fv.STATE_SET).alias("n_sets"),
        )
    )


def without_dictionary(rows: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Rows whose key the dictionary lacks."""
    return rows.join(dictionary.select(key).distinct(), key, "left_anti")


def leakage(df: DataFrame, stamps: Iterable[str], t: str = "prediction_time") -> DataFrame:
    """Rows whose past-only timestamps are not strictly before the prediction."""
    return df.agg(*[S.count_if(F.col(c) >= F.col(t)).alias(f"future_{c}") for c in stamps])


def structure_checks(panel: DataFrame, label: str = "target_fault_24_48h") -> DataFrame:
    """Counts of rows that break a rule of the panel; all have to be zero."""
    no_numbers = F.col("numeric_n_1d") == 0
    any_number = (
        F.col("numeric_mean_1d").isNotNull()
        | F.col("numeric_std_1d").isNotNull()
        | F.col("numeric_min_1d").isNotNull()
        | F.col("numeric_max_1d").isNotNull()
    )
    shrinking = (
        (F.col("events_1d") < 0)
        | (F.col("events_7d") < F.col("events_1d"))
        | (F.col("events_30d") < F.col("events_7d"))
    )
    keys = panel.groupBy("channel_id", "prediction_time").agg(
        F.count("*").alias("_n"),
        S.count_if(F.col("feature_max_ts") >= F.col("prediction_time")).alias("_future"),
        S.count_if(F.col("last_state_ts") >= F.col("prediction_time")).alias("_state"),
        S.count_if(~F.col(label).isin(0, 1)).alias("_label"),
        S.count_if(shrinking).alias("_counts"),
        S.count_if(no_numbers & any_number).alias("_numeric"),
    )
    return keys.agg(
        F.sum("_n").alias("rows"),
        F.sum(F.col("_n") - 1).alias("duplicate_keys"),
        F.sum("_future").alias("future_features"),
        F.sum("_state").alias("future_state"),
        F.sum("_label").alias("invalid_labels"),
        F.sum("_counts").alias("invalid_counts"),
        F.sum("_numeric").alias("numbers_without_measurements"),
    )


def event_reconciliation(daily: DataFrame, events: DataFrame) -> DataFrame:
    """Events of the daily table against the journal it was made from."""
    left = daily.agg(F.sum("events").alias("daily_events")).withColumn("_one", F.lit(1))
    right = events.agg(F.count("*").alias("journal_events")).withColumn("_one", F.lit(1))
    both = left.join(right, "_one").drop("_one")
    return both.withColumn("balanced", F.col("daily_events") == F.col("journal_events"))


def split_audit(
    splits: dict[str, DataFrame], features: list[str], label: str, normal: str = fv.NORMAL
) -> DataFrame:
    """Every check of the prepared splits, one scan per split, as one table.

    The split used only for scoring has neither labels nor a follow-up.
    """
    t = F.col("prediction_time")
    always = ["channel_id", "prediction_time", "sensor_type_current", "feature_max_ts"]
    always += ["at_risk_with_history", "last_explicit_state", *features]
    labelled = ["target_start", "target_end", "channel_followup_48h", "global_complete_24_48h"]
    parts = []
    for name, df in splits.items():
        scoring = name == "scoring_latest"
        require_columns(df, always if scoring else [*always, *labelled, label])
        nothing = F.lit(0).cast("long")
        state_wrong = F.col("at_risk_with_history") & ~F.col("last_explicit_state").eqNullSafe(
            F.lit(normal)
        )
        checks: dict[str, Column] = {
            "future_features": S.count_if(
                F.col("feature_max_ts").isNull() | (F.col("feature_max_ts") >= t)
            ),
            "invalid_eligible_state": S.count_if(state_wrong),
            "missing_keys": S.count_if(F.col("channel_id").isNull() | t.isNull()),
        }
        if scoring:
            for check in ("wrong_window", "ineligible", "incomplete", "invalid_labels", "positives"):
                checks[check] = nothing
        else:
            right_start = F.col("target_start").eqNullSafe(t + F.expr("interval 24 hours"))
            right_end = F.col("target_end").eqNullSafe(t + F.expr("interval 48 hours"))
            seen = F.coalesce(
                F.col("channel_followup_48h") & F.col("global_complete_24_48h"), F.lit(False)
            )
            checks["wrong_window"] = S.count_if(~(right_start & right_end))
            checks["ineligible"] = S.count_if(
                ~F.col("at_risk_with_history").eqNullSafe(F.lit(True))
            )
            checks["incomplete"] = S.count_if(~seen)
            checks["invalid_labels"] = S.count_if(
                F.col(label).isNull() | ~F.col(label).isin(0, 1)
            )
            checks["positives"] = F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))
        weighted = {"sampling_probability", "sample_weight"} <= set(df.columns)
        if name == "train_compact" and not weighted:
            raise ValueError("a sampled split needs sample_weight and sampling_probability")
        checks["invalid_weights"] = S.count_if(bad_weight()) if weighted else nothing
        per_key = df.groupBy("channel_id", "prediction_time").agg(
            F.count("*").alias("_n"), *[c.alias(k) for k, c in checks.items()]
        )
        per_channel = per_key.groupBy("channel_id").agg(
            F.sum("_n").alias("_n"),
            F.sum(F.col("_n") - 1).alias("_extra"),
            F.min("prediction_time").alias("_first"),
            F.max("prediction_time").alias("_last"),
            *[F.sum(k).alias(k) for k in checks],
        )
        parts.append(
            per_channel.agg(
                F.lit(name).alias("split"),
                F.sum("_n").alias("rows"),
                F.min("_first").alias("first_time"),
                F.max("_last").alias("last_time"),
                F.count("channel_id").alias("channels"),
                F.sum("_extra").alias("duplicate_keys"),
                *[F.sum(k).alias(k) for k in checks],
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


AUDIT_FAILURES = [
    "duplicate_keys",
    "missing_keys",
    "future_features",
    "wrong_window",
    "ineligible",
    "incomplete",
    "invalid_labels",
    "invalid_eligible_state",
    "invalid_weights",
]


def audit_splits(
    splits: dict[str, DataFrame], features: list[str], label: str, normal: str = fv.NORMAL
) -> DataFrame:
    """The audit table; raises when a check fails or target windows overlap."""
    report = split_audit(splits, features, label, normal)
    rows = {r["split"]: r for r in report.collect()}  # one row per split
    for name, row in rows.items():
        failed = {c: row[c] for c in AUDIT_FAILURES if row[c]}
        if failed:
            raise AuditError(f"{name}: {failed}")
    import datetime as dt

    order = [n for n in ("train", "train_compact", "validation", "test") if n in rows]
    for left, right in zip(order, order[1:]):
        if rows[left]["last_time"] + dt.timedelta(hours=48) > rows[right]["first_time"]:
            raise AuditError(f"{left}/{right}: target windows overlap")
    return report


def bad_weight() -> Column:
    """True where a weight is not the inverse of its sampling probability."""
    p, w = F.col("sampling_probability"), F.col("sample_weight").cast("double")
    fine = (p > 0) & (p <= 1) & S.is_finite(w) & (F.abs(w * p - 1) <= 1e-5)
    return ~F.coalesce(fine, F.lit(False))


def weight_check(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), S.count_if(bad_weight()).alias("invalid_weights"))


def plan_checks(repair_plan: DataFrame, monthly_plan: DataFrame) -> DataFrame:
    """Counts of plan rows that break a rule; all have to be zero."""
    late = F.col("dismantle_start") > F.col("acceptance_date")
    labels = repair_plan.groupBy("object_label").agg(
        F.count("*").alias("_n"), S.count_if(late).alias("_late")
    )
    left = labels.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated_labels"),
        F.coalesce(F.sum("_late"), F.lit(0)).alias("start_after_acceptance"),
    )
    known = F.col("action").isin(fv.PLAN_ACTIONS)
    right = monthly_plan.agg(
        S.count_if(~F.coalesce(known, F.lit(False))).alias("unknown_actions"),
        S.count_if(F.col("quantity").cast("string").try_cast("double").isNull()).alias(
            "quantity_not_numeric"
        ),
    )
    one = F.lit(1)
    return left.withColumn("_one", one).join(right.withColumn("_one", one), "_one").drop("_one")


def request_problems(df: DataFrame, pattern: str, normal: str = fv.NORMAL) -> DataFrame:
    """Counts of rows a batch of prediction requests must not contain."""
    t, eligible = F.col("prediction_time"), F.coalesce(F.col("eligible"), F.lit(False))
    state = F.lower("last_explicit_state")
    per_key = df.groupBy("entity_id", "prediction_time").agg(
        F.count("*").alias("_n"),
        S.count_if(~S.matches(F.col("sensor_type"), pattern)).alias("_type"),
        S.count_if(eligible & ~state.eqNullSafe(F.lit(normal))).alias("_state"),
        S.count_if(
            eligible & (F.col("last_state_ts").isNull() | (F.col("last_state_ts") >= t))
        ).alias("_late"),
    )
    n = F.col("_n")
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col("entity_id").isNull(), n)), F.lit(0)).alias("missing_ids"),
        F.coalesce(
            F.sum(F.when(t.isNull() | ~S.is_midnight(t), n)), F.lit(0)
        ).alias("not_midnight"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_keys"),
        F.coalesce(F.sum("_type"), F.lit(0)).alias("wrong_sensor_type"),
        F.coalesce(F.sum("_state"), F.lit(0)).alias("eligible_not_normal"),
        F.coalesce(F.sum("_late"), F.lit(0)).alias("state_not_before"),
    )


def validate_request(
    df: DataFrame, features: list[str], pattern: str, normal: str = fv.NORMAL
) -> DataFrame:
    """The request itself, after one aggregation proved it acceptable."""
    known = {"entity_id", "prediction_time", "sensor_type", "eligible", "last_explicit_state"}
    require_columns(df, known | {"last_state_ts"} | set(features))
    if dict(df.dtypes)["prediction_time"] != "timestamp_ntz":
        raise ValueError("prediction_time has to be source-local time without a zone")
    found = request_problems(df, pattern, normal).first().asDict()
    wrong = {name: n for name, n in found.items() if n}
    if wrong:
        raise AuditError(f"request refused: {wrong}")
    return df


def daily_gaps(daily: DataFrame) -> DataFrame:
    return C.missing_days(C.coverage_of_daily(daily).select("day"))
