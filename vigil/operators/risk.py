"""Prediction records, tickets and the views built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators.ordered import number_rows
from vigil.operators.ranges import positions
from vigil.operators.states import gap_sessions


def risk_band(score: Column, threshold: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit("unavailable"))
        .when(score >= threshold, F.lit("high"))
        .when(score >= threshold * 0.5, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def recommendation(risk: Column, target: Column) -> Column:
    text = (
        F.when(risk == "high", F.lit(fv.RECOMMEND_HIGH))
        .when(risk == "unavailable", F.lit(fv.RECOMMEND_NO_SCORE))
        .otherwise(F.lit(fv.RECOMMEND_WATCH))
    )
    suffix = F.lit("")
    for name, words in fv.RECOMMEND_SUFFIX.items():
        suffix = F.when(target == name, F.lit(words)).otherwise(suffix)
    return F.concat(text, suffix)


def factors(df: DataFrame) -> Column:
    """Observed context of a prediction: label and value of each known factor."""
    present = [
        F.struct(
            F.lit(name).alias("feature"),
            F.lit(label).alias("label"),
            F.round(F.col(name).cast("double"), 2).alias("value"),
        )
        for name, label in fv.FACTOR_LABELS.items()
        if name in df.columns
    ]
    if not present:
        return F.array().cast("array<struct<feature:string,label:string,value:double>>")
    return F.filter(F.array(*present), lambda f: f["value"].isNotNull())


def with_smoke_rows(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sensor rows of smoke detectors a second time under the smoke direction.

    A feature the rows lack is zero (a channel without labelled history).  Each
    row opens its directions, so the rows are scanned once.
    """
    also = (F.col("direction") == "sensor") & S.matches(
        F.col("sensor_type"), fv.DIRECTION_PATTERNS["smoke"]
    )
    directions = F.when(also, F.array(F.col("direction"), F.lit("smoke"))).otherwise(
        F.array(F.col("direction"))
    )
    absent = {f: F.lit(0.0) for f in features if f not in rows.columns}
    return rows.withColumns(absent).withColumn("direction", F.explode(directions))


def _per_direction(models: dict[str, dict], field: str) -> Column:
    value = F.lit(None)
    for direction, meta in models.items():
        value = F.when(F.col("direction") == direction, F.lit(meta[field])).otherwise(value)
    return value


def prediction_table(
    scored: DataFrame, models: dict[str, dict], objects: DataFrame, mode: str = "real"
) -> DataFrame:
    """Prediction records with id, window, risk, factors and recommendation.

    ``models`` holds version, threshold and target of each direction; ``objects``
    has the columns ``object_id`` and ``object_name``.
    """
    t = F.col("prediction_time")
    horizons = {
        d: {"lo": fv.HORIZON_HOURS[m["target"]][0], "hi": fv.HORIZON_HOURS[m["target"]][1]}
        for d, m in models.items()
    }
    named = scored.join(objects, "object_id", "left").withColumns(
        {
            "model_version": _per_direction(models, "version"),
            "threshold": _per_direction(models, "threshold").cast("double"),
            "_target": _per_direction(models, "target"),
            "_lo": _per_direction(horizons, "lo"),
            "_hi": _per_direction(horizons, "hi"),
        }
    )
    score = F.col("score")
    risk = risk_band(score, F.col("threshold"))

    def text(name: str, missing: str = "") -> Column:
        if name not in scored.columns:
            return F.lit(missing)
        return F.coalesce(F.col(name).cast("string"), F.lit(missing))

    def later(hours: str) -> Column:
        return F.timestamp_add("HOUR", F.col(hours), t).cast("timestamp_ntz")

    identity = S.surrogate_id(
        F.col("direction"), F.col("entity_id"), S.iso_text(t), F.col("model_version")
    )
    return named.select(
        identity.alias("id"),
        "direction",
        F.col("entity_id").cast("string").alias("entity_id"),
        F.col("object_id").cast("string").alias("object_id"),
        F.coalesce("object_name", F.col("object_id").cast("string")).alias("object_name"),
        text("sensor_type").alias("sensor_type"),
        text("system_type").alias("system_type"),
        text("sensor_name").alias("sensor_name"),
        text("system_tag").alias("system_tag"),
        "prediction_time",
        later("_lo").alias("target_start"),
        later("_hi").alias("target_end"),
        F.round(score, 6).alias("score"),
        risk.alias("risk"),
        "threshold",
        "model_version",
        text("last_explicit_state", fv.UNKNOWN).alias("state"),
        factors(scored).alias("factors"),
        recommendation(risk, F.col("_target")).alias("recommendation"),
        F.lit(mode).alias("mode"),
    )


def append_new(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, each key once."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


#: Columns the store of predictions is partitioned by; an id is made of both and of the entity.
STORE_PARTITIONS = ["model_version", "prediction_day"]


def candidates(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The part of a store that can hold ids of ``new``: its versions and the span of its days.

    Equal ids mean equal version and time, so other partitions are not read.
    """
    span = new.agg(F.collect_set("model_version"), F.min("prediction_day"), F.max("prediction_day")).first()
    versions, first, last = span  # the versions of a batch are a handful
    return stored.where(F.col("model_version").isin(versions) & F.col("prediction_day").between(first, last))


def append_to_store(new: DataFrame, path: str) -> None:
    """Add the predictions that the store at ``path`` lacks, all columns kept; a repeated call adds nothing."""
    rows = new.withColumn("prediction_day", F.to_date("prediction_time")).dropDuplicates(["id"])
    try:
        stored = new.sparkSession.read.parquet(path)
    except AnalysisException:  # nothing is stored yet
        stored = None
    if stored is not None:
        rows = rows.join(candidates(stored, rows).select("id"), "id", "left_anti")
    rows.write.mode("append").option("compression", "zstd").partitionBy(*STORE_PARTITIONS).parquet(path)


def active(predictions: DataFrame, models: dict[str, dict], latest: bool = True) -> DataFrame:
    """Predictions of the active model versions, of the last time only if asked."""
    wanted = F.lit(False)
    for direction, meta in models.items():
        wanted = wanted | (
            (F.col("direction") == direction) & (F.col("model_version") == meta["version"])
        )
    chosen = predictions.where(wanted)
    if not latest:
        return chosen
    # A global aggregate: exactly one row.
    last = F.broadcast(chosen.agg(F.max("prediction_time").alias("prediction_time")))
    return chosen.join(last, "prediction_time", "left_semi").select(*predictions.columns)


def search(
    predictions: DataFrame,
    direction: str | None = None,
    risk: str | None = None,
    object_id: str | None = None,
    term: str | None = None,
) -> DataFrame:
    """Filter by direction, risk and object and by text in six fields."""
    found = predictions
    for column, value in (("direction", direction), ("risk", risk), ("object_id", object_id)):
        if value:
            found = found.where(F.col(column) == value)
    if term:
        fields = [
            "object_name",
            "entity_id",
            "sensor_type",
            "system_type",
            "sensor_name",
            "system_tag",
        ]
        text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))
        found = found.where(F.instr(text, term.lower()) > 0)
    return found


def ranked(predictions: DataFrame) -> DataFrame:
    return predictions.orderBy(
        F.desc_nulls_last("score"), F.desc("prediction_time"), F.asc("id")
    )


#: Order of a list of predictions: highest score first, missing scores last.
RANKED = (F.desc_nulls_last, "score"), (F.desc_nulls_last, "prediction_time"), (F.asc_nulls_first, "id")
#: Rows of a partition of a ranked table.
RANKED_ROWS = 100_000
#: Partitions of a ranked table at most: each is a folder that the driver commits and lists.
RANKED_BLOCKS = 256


def placed(predictions: DataFrame) -> DataFrame:
    """Predictions with their ``position`` in the ranked list (from 0) and its ``total``."""
    return positions(predictions, [], [order(c) for order, c in RANKED], "position", "total")


def prediction_page(
    predictions: DataFrame, limit: int = 100, offset: int = 0, **filters: str | None
) -> tuple[int, DataFrame]:
    """Number of matching predictions and one page of them, highest score first.

    Positions come from ranges, so rows before the page are neither skipped in
    one task nor sent to the driver.
    """
    found = search(predictions, **filters)
    page = placed(found).where(F.col("position").between(offset, offset + limit - 1))
    return found.count(), page.orderBy("position").drop("position", "total")


def write_ranked(predictions: DataFrame, path: str, rows: int = RANKED_ROWS) -> None:
    """The ranked list as a table with ``rows`` rows a partition (``block``), for pages at any depth.

    A list that would need more than ``RANKED_BLOCKS`` partitions gets that many, with more rows each.
    """
    wide = F.greatest(F.lit(rows), F.ceil(F.col("total") / RANKED_BLOCKS))
    blocks = placed(predictions).withColumn("block", F.floor(F.col("position") / wide))
    dealt = blocks.repartition("block").sortWithinPartitions("block", "position")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("block").parquet(path)


def ranked_page(spark: SparkSession, path: str, limit: int, offset: int, rows: int = RANKED_ROWS) -> DataFrame:
    """One page of a ranked table; only the partitions it lies in are read."""
    last = offset + limit - 1
    stored = spark.read.parquet(path)
    # each row knows how many there are
    wide = max(rows, math.ceil(stored.select("total").first()["total"] / RANKED_BLOCKS))
    blocks = stored.where(F.col("block").between(offset // wide, last // wide))
    return blocks.where(F.col("position").between(offset, last)).drop("block").orderBy("position")


def page_after(
    predictions: DataFrame, after: tuple | None, limit: int = 100, **filters: str | None
) -> DataFrame:
    """The page that follows a row (its score, time and id); the first page without one.

    No task and no driver keeps more than ``limit`` rows, however deep the page.
    """
    found = search(predictions, **filters)
    if after is not None:
        score, time, id_ = after
        at, later = F.col("prediction_time"), F.col("id") > id_
        beyond = (at < F.lit(time)) | ((at == F.lit(time)) & later)
        if score is None:
            beyond = F.col("score").isNull() & beyond
        else:
            own = F.col("score")
            beyond = own.isNull() | (own < F.lit(score)) | ((own == F.lit(score)) & beyond)
        found = found.where(beyond)
    return ranked(found).limit(limit)


def kpis(predictions: DataFrame, tickets: DataFrame) -> DataFrame:
    """Head counts of the dashboard in one aggregation plus the open tickets."""
    risk, direction = F.col("risk"), F.col("direction")
    cells = {
        "channels": F.count("*"),
        "high_risk": S.count_if(risk == "high"),
        "unavailable": S.count_if(risk == "unavailable"),
    }
    for name in fv.DIRECTION_PATTERNS:
        cells[f"{name}_total"] = S.count_if(direction == name)
        cells[f"{name}_high"] = S.count_if((direction == name) & (risk == "high"))
    heads = predictions.agg(*[c.alias(n) for n, c in cells.items()])
    opened = tickets.agg(
        S.count_if(F.col("status").isin(fv.OPEN_STATUSES)).alias("open_tickets")
    )
    one = F.lit(1)
    return heads.withColumn("_one", one).join(opened.withColumn("_one", one), "_one").drop("_one")


def trend(predictions: DataFrame, days: int = 30) -> DataFrame:
    """High risks per day and direction over the last days of predictions."""
    # A global aggregate: exactly one row.
    last = predictions.agg(F.max("prediction_time").alias("_last")).withColumn("_one", F.lit(1))
    recent = (
        predictions.withColumn("_one", F.lit(1))
        .join(F.broadcast(last), "_one")
        .where(F.col("prediction_time") >= F.col("_last") - F.expr(f"interval {days - 1} days"))
    )
    high = F.col("risk") == "high"
    return recent.groupBy(F.date_format("prediction_time", "yyyy-MM-dd").alias("date")).agg(
        F.count("*").alias("total"),
        *[
            S.count_if(high & (F.col("direction") == name)).alias(name)
            for name in fv.DIRECTION_PATTERNS
        ],
    )


def by_object(objects: DataFrame, predictions: DataFrame) -> DataFrame:
    """Objects with their channels, high risks and highest score."""
    groups = predictions.groupBy("object_id").agg(
        F.count("*").alias("channels"),
        S.count_if(F.col("risk") == "high").alias("high_risk"),
        F.max("score").alias("max_score"),
    )
    return objects.join(groups, "object_id", "left").fillna(0, ["channels", "high_risk"])


def site_ranking(objects_with_risk: DataFrame, n: int = 5) -> DataFrame:
    best = F.coalesce(F.col("max_score"), F.lit(-1.0))
    return objects_with_risk.orderBy(F.desc("high_risk"), best.desc(), "object_id").limit(n)


def data_quality(rows: DataFrame) -> DataFrame:
    eligible = F.coalesce(F.col("eligible"), F.lit(False))
    return rows.agg(
        F.max("prediction_time").alias("snapshot_time"),
        F.count("*").alias("scoring_rows"),
        S.count_if(eligible).alias("eligible_rows"),
        S.count_if(~eligible).alias("unavailable_rows"),
    )


def direction_coverage(rows: DataFrame) -> DataFrame:
    """Channels and eligible rows per direction and type; a missing type stays."""
    per_channel = rows.groupBy("direction", "sensor_type", "entity_id").agg(
        S.count_if(F.col("eligible")).alias("_n")
    )
    return per_channel.groupBy("direction", "sensor_type").agg(
        F.count("entity_id").alias("channels"), F.sum("_n").alias("eligible")
    )


def scoring_rows(panel: DataFrame, channels: DataFrame, features: Sequence[str]) -> DataFrame:
    """Panel rows under the serving names, with texts that are never NULL.

    ``channels`` has ``entity_id``, ``system_type``, ``sensor_name`` and
    ``system_tag``.
    """
    base = panel.select(
        F.col("channel_id").cast("string").alias("entity_id"),
        F.coalesce(F.col("object_id_current").cast("string"), F.lit(fv.UNKNOWN)).alias("object_id"),
        F.coalesce("sensor_type_current", F.lit(fv.UNKNOWN)).alias("sensor_type"),
        "prediction_time",
        F.coalesce("at_risk_with_history", F.lit(False)).alias("eligible"),
        F.coalesce("last_explicit_state", F.lit(fv.UNKNOWN)).alias("last_explicit_state"),
        "last_state_ts",
        *features,
    )
    joined = base.join(channels, "entity_id", "left")
    return joined.fillna("", ["system_type", "sensor_name", "system_tag"])


def publication_metadata(
    rows: DataFrame, snapshot: DataFrame, channels: DataFrame, objects: DataFrame
) -> DataFrame:
    """Sizes of a published set and what its dictionaries do not know."""
    marked = rows.join(
        channels.select("entity_id").distinct().withColumn("_channel", F.lit(True)),
        "entity_id",
        "left",
    ).join(
        objects.select("object_id").distinct().withColumn("_object", F.lit(True)),
        "object_id",
        "left",
    )
    one = F.lit(1)
    sizes = marked.agg(
        F.count("*").alias("rows"),
        F.count_distinct("entity_id").alias("channels"),
        S.count_if(F.col("_channel").isNull()).alias("rows_without_channel"),
        F.count_distinct(F.when(F.col("_object").isNull(), F.col("object_id"))).alias(
            "objects_without_name"
        ),
    )
    source = snapshot.agg(F.count("*").alias("snapshot_channels"))
    both = sizes.withColumn("_one", one).join(source.withColumn("_one", one), "_one").drop("_one")
    return both.withColumn(
        "excluded_snapshot_channels", F.col("snapshot_channels") - F.col("channels")
    )


def daily_observations(
    daily: DataFrame, channels: DataFrame, until: Column, patterns: dict[str, str] | None = None
) -> DataFrame:
    """Messages, alarms and faults per date, faults also by direction.

    ``channels`` has ``channel_id`` and ``sensor_type``.
    """
    chosen = patterns or {k: fv.DIRECTION_PATTERNS[k] for k in ("sensor", "infrastructure")}
    known = channels.select("channel_id", "sensor_type", F.lit(True).alias("_known"))
    joined = daily.where(F.col("day") < until).join(known, "channel_id", "left")
    faults = F.col("fault_messages")
    return joined.groupBy(F.col("day").alias("date")).agg(
        F.sum("events").alias("events"),
        F.sum("alarms").alias("alarms"),
        F.sum("fault_messages").alias("fault_messages"),
        F.count("channel_id").alias("active_channels"),
        *[
            F.sum(F.when(S.matches(F.col("sensor_type"), p), faults).otherwise(F.lit(0))).alias(n)
            for n, p in chosen.items()
        ],
        S.count_if(F.col("_known").isNull()).alias("unmapped_channel_days"),
    )


TICKET_COLUMNS = [
    "id",
    "prediction_id",
    "status",
    "created_at",
    "updated_at",
    "comment",
    "automatic",
]


def new_tickets(
    predictions: DataFrame,
    tickets: DataFrame,
    now: Column,
    comment: str = fv.AUTOMATIC_COMMENT,
    automatic: bool = True,
) -> DataFrame:
    """Tickets to add for scored high risks that have no open ticket yet."""
    opened = tickets.where(F.col("status").isin(fv.OPEN_STATUSES)).select("prediction_id")
    wanted = (
        predictions.where((F.col("risk") == "high") & F.col("score").isNotNull())
        .select(F.col("id").alias("prediction_id"))
        .distinct()
        .join(opened, "prediction_id", "left_anti")
    )
    numbered = number_rows(wanted, "prediction_id", "_number").withColumn("_one", F.lit(1))
    # A global aggregate: exactly one row.
    last = tickets.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last")).withColumn(
        "_one", F.lit(1)
    )
    return numbered.join(F.broadcast(last), "_one").select(
        (F.col("_last") + F.col("_number") + 1).alias("id"),
        "prediction_id",
        F.lit("new").alias("status"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(comment).alias("comment"),
        F.lit(int(automatic)).alias("automatic"),
    )


def refused_tickets(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Requested tickets that cannot be opened, with the reason."""
    known = predictions.select(F.col("id").alias("prediction_id"), "score", F.lit(1).alias("_known"))
    joined = requests.join(known, "prediction_id", "left")
    reason = F.when(F.col("_known").isNull(), F.lit("unknown prediction")).when(
        F.col("score").isNull(), F.lit("no score")
    )
    return joined.select("prediction_id", reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def apply_changes(tickets: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tickets after a batch of status changes, and the refused requests.

    ``requests`` has ticket id, status, comment and time; the last request for a
    ticket counts.
    """
    last = requests.groupBy("id").agg(
        F.max_by(F.struct("status", "comment", "at"), "at").alias("_wanted")
    )
    allowed = F.lit(False)
    for status, following in fv.TICKET_CHANGES.items():
        allowed = allowed | (
            (F.col("status") == status) & F.col("_wanted.status").isin([status, *following])
        )
    joined = tickets.join(last, "id", "left")
    go = F.coalesce(allowed, F.lit(False))
    changed = joined.select(
        "id",
        "prediction_id",
        F.when(go, F.col("_wanted.status")).otherwise(F.col("status")).alias("status"),
        "created_at",
        F.when(go, F.col("_wanted.at")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(go, F.col("_wanted.comment")).otherwise(F.col("comment")).alias("comment"),
        "automatic",
    )
    current = last.join(tickets.select("id", "status"), "id", "left")
    reason = F.when(F.col("status").isNull(), F.lit("unknown ticket")).when(
        ~F.coalesce(allowed, F.lit(False)), F.lit("status change not allowed")
    )
    refused = current.select(
        "id", F.col("_wanted.status").alias("wanted"), reason.alias("reason")
    ).where(F.col("reason").isNotNull())
    return changed, refused


def ticket_details(tickets: DataFrame, predictions: DataFrame) -> DataFrame:
    """Tickets with their prediction, newest first."""
    facts = predictions.select(
        F.col("id").alias("prediction_id"), "entity_id", "object_name", "score", "risk"
    )
    return tickets.join(facts, "prediction_id").orderBy(F.desc("id"))


def alert_cards(alerts: DataFrame, key: str = "entity_id", gap_days: int = 1) -> DataFrame:
    """Repeated daily alerts of a channel as one card with its first and last day."""
    cards = gap_sessions(alerts, key, "prediction_time", gap_days * 24 * 60, break_on_date=False)
    return cards.select(
        key,
        F.col("episode_id").alias("card"),
        F.col("start_ts").alias("first_alert"),
        F.col("end_ts").alias("last_alert"),
        F.col("messages").alias("alerts"),
    )
