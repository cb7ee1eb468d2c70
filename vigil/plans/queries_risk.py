"""Queries: prediction records, tickets and dashboard views."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators import calendar as C
from vigil.operators import quality as Q
from vigil.operators import risk as K
from vigil.operators import splits as SP
from vigil.plans import bindings as B
from vigil.plans.queries_panel import rounded
from vigil.plans.queries_splits import DIRECTIONS
from vigil.plans.registry import part, query
from vigil.session import scratch_path
from vigil.sources import tables as T

MODELS = {
    "sensor": {"version": "s-1", "threshold": 0.3, "target": "target_fault_24_48h"},
    "infrastructure": {"version": "i-1", "threshold": 0.4, "target": "target_monthly"},
    "smoke": {"version": "m-1", "threshold": 0.2, "target": "smoke_signal_24_48h"},
}
_FEATURES = ["fault_messages_30d", "undefined_messages_7d", "alarms_7d", "event_ratio_1d_7d", "events_30d"]


def _channels(spark, sf):
    return B.channels(spark, sf).select(
        F.col(fv.CHANNEL_KEY).cast("string").alias("entity_id"),
        F.col(fv.SYSTEM_TYPE).alias("system_type"),
        F.col(fv.SENSOR_NAME).alias("sensor_name"),
        F.when(F.col(fv.OBJECT_KEY) > 3, F.col(fv.SYSTEM_TAG)).alias("system_tag"),
    )


def _objects(spark, sf):
    named = B.objects(spark, sf).where(F.col(fv.OBJECT_KEY) % 5 != 0)  # some objects have no name
    return named.select(
        F.col(fv.OBJECT_KEY).cast("string").alias("object_id"),
        F.col(fv.OBJECT_NAME).alias("object_name"),
    )


def rows(spark, sf):
    """Serving rows of every direction with a simple score of the eligible ones."""
    base = K.scoring_rows(B.panel(spark, sf), _channels(spark, sf), _FEATURES)
    routed = SP.route_directions(base, {k: DIRECTIONS[k] for k in ("sensor", "infrastructure")})
    risky = F.least(
        F.lit(0.99), F.col("alarms_7d") / 32 + F.col("fault_messages_30d") / 64
    )
    return routed.withColumn("score", F.when(F.col("eligible"), risky))


part(
    "rows_t",
    f"""SELECT p.channel_id AS entity_id, p.object_id_current::VARCHAR AS object_id, p.sensor_type_current AS sensor_type,
        p.prediction_time, p.at_risk_with_history AS eligible, coalesce(p.last_explicit_state, 'unknown') AS last_explicit_state,
        p.last_state_ts, {", ".join("p." + f for f in _FEATURES)}, c.system_type, c.sensor_name,
        if(c.object_id > 3, c.system_tag, '') AS system_tag, d.direction,
        CASE WHEN p.at_risk_with_history THEN least(0.99, p.alarms_7d / 32 + p.fault_messages_30d / 64)::DOUBLE END AS score
        FROM panel_t p JOIN channels_t c ON c.channel_key::VARCHAR = p.channel_id
        JOIN (VALUES ('sensor', 'auto|build|house'), ('infrastructure', 'mach|^furn')) d(direction, pattern)
          ON regexp_matches(lower(p.sensor_type_current), d.pattern)""",
)
_ROW_COLUMNS = "entity_id, object_id, sensor_type, prediction_time, direction, system_type, sensor_name, system_tag"


@query(
    "scoring_rows",
    f"SELECT {_ROW_COLUMNS}, eligible::INT AS eligible, last_explicit_state, round(score, 9) AS score FROM rows_t",
)
def _(spark, sf):
    out = rows(spark, sf).select(
        *_ROW_COLUMNS.split(", "), "eligible", "last_explicit_state", "score"
    )
    return rounded(out, ["score"], 9)


def _predictions(spark, sf):
    return K.prediction_table(rows(spark, sf), MODELS, _objects(spark, sf))


def predictions(spark, sf):
    """The stored prediction records, which the views and tickets read."""
    return B.prepared(spark, sf, "predictions", _predictions)


def stored(spark, sf):
    """The stored records of the active versions among those of a retired one, all of them high risks."""
    found = predictions(spark, sf)
    retired = {"model_version": F.lit("s-0"), "risk": F.lit("high"), "id": F.concat(F.lit("old-"), "id")}
    return found.unionByName(found.where("direction = 'sensor'").withColumns(retired))


part(
    "predictions_t",
    """SELECT substr(sha256(concat_ws('|', direction, entity_id, strftime(prediction_time, '%Y-%m-%dT%H:%M:%S'), version)), 1, 24) AS id,
         direction, entity_id, r.object_id, coalesce(o.n_name, r.object_id) AS object_name, sensor_type, system_type,
         sensor_name, system_tag, prediction_time, prediction_time + INTERVAL 24 HOUR AS target_start,
         prediction_time + m.hi * INTERVAL 1 HOUR AS target_end, round(score, 6) AS score,
         CASE WHEN score IS NULL THEN 'unavailable' WHEN score >= m.threshold THEN 'high'
              WHEN score >= m.threshold / 2 THEN 'medium' ELSE 'low' END AS risk,
         m.threshold::DOUBLE AS threshold, m.version AS model_version, last_explicit_state AS state, 'real' AS mode,
         fault_messages_30d, undefined_messages_7d, alarms_7d
       FROM rows_t r JOIN (VALUES ('sensor', 's-1', 0.3, 48), ('infrastructure', 'i-1', 0.4, 744)) m(direction, version, threshold, hi)
         USING (direction)
       LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) o ON o.n_nationkey::VARCHAR = r.object_id""",
)
_RECORD = """id, direction, entity_id, object_id, object_name, sensor_type, system_type, sensor_name, system_tag,
  prediction_time, target_start, target_end, score, risk, threshold, model_version, state, mode"""


@query(
    "prediction_records",
    f"""SELECT {_RECORD}, (3 + (alarms_7d > 0 OR true)::INT)::INT AS factor_count, fault_messages_30d::DOUBLE AS first_factor,
        CASE risk WHEN 'high' THEN 'Проверить журнал и запланировать диагностику'
          WHEN 'unavailable' THEN 'Проверить состояние и полноту данных' ELSE 'Продолжить наблюдение' END ||
        CASE direction WHEN 'infrastructure' THEN '; экспериментальный месячный прогноз, низкий балл не подтверждает исправность'
          ELSE '' END AS recommendation
        FROM predictions_t JOIN (SELECT entity_id, prediction_time, direction, event_ratio_1d_7d IS NOT NULL AS has FROM rows_t)
          USING (entity_id, prediction_time, direction) WHERE has
        UNION ALL SELECT {_RECORD}, 3, fault_messages_30d::DOUBLE,
        CASE risk WHEN 'high' THEN 'Проверить журнал и запланировать диагностику'
          WHEN 'unavailable' THEN 'Проверить состояние и полноту данных' ELSE 'Продолжить наблюдение' END ||
        CASE direction WHEN 'infrastructure' THEN '; экспериментальный месячный прогноз, низкий балл не подтверждает исправность'
          ELSE '' END
        FROM predictions_t JOIN (SELECT entity_id, prediction_time, direction, event_ratio_1d_7d IS NOT NULL AS has FROM rows_t)
          USING (entity_id, prediction_time, direction) WHERE NOT has""",
)
def _(spark, sf):
    found = _predictions(spark, sf)
    return found.withColumns(
        {"factor_count": F.size("factors"), "first_factor": F.col("factors")[0]["value"]}
    ).drop("factors")


@query(
    "smoke_rows",
    f"""SELECT direction, count(*) AS rows, sum(channel_history_rate)::DOUBLE AS history FROM
        (SELECT direction, 0.0 AS channel_history_rate FROM rows_t
         UNION ALL SELECT 'smoke', 0.0 FROM rows_t WHERE direction = 'sensor' AND sensor_type = 'дым ' || sensor_type) GROUP BY 1
        UNION ALL SELECT 'smoke', count(*), 0 FROM rows_t WHERE direction = 'sensor'""",
)
def _(spark, sf):
    smoky = rows(spark, sf).withColumn("sensor_type", F.concat(F.lit("Дым "), "sensor_type"))
    both = K.with_smoke_rows(smoky, ["channel_history_rate"])
    return both.groupBy("direction").agg(
        F.count("*").alias("rows"), F.sum("channel_history_rate").alias("history")
    )


part(
    "latest_t",
    "SELECT * FROM predictions_t WHERE prediction_time = (SELECT max(prediction_time) FROM predictions_t)",
)


@query("active_predictions", f"SELECT {_RECORD} FROM latest_t")
def _(spark, sf):
    found = K.active(predictions(spark, sf), MODELS)
    return found.select(*[c.strip() for c in _RECORD.split(",")])


@query(
    "appended_predictions",
    """SELECT direction, count(*) AS rows, count(DISTINCT id) AS ids, sum(3 + has::INT)::BIGINT AS factors
       FROM predictions_t JOIN (SELECT entity_id, prediction_time, direction, event_ratio_1d_7d IS NOT NULL AS has FROM rows_t)
         USING (entity_id, prediction_time, direction) GROUP BY 1""",
)
def _(spark, sf):
    """Some records, then all of them twice; each append reads the days and versions it can meet."""
    path = scratch_path(spark, "predictions")
    whole = predictions(spark, sf)
    for batch in (whole.where("risk = 'high'"), whole, whole):
        K.append_to_store(batch, path)
    return spark.read.parquet(path).groupBy("direction").agg(
        F.count("*").alias("rows"),
        F.count_distinct("id").alias("ids"),
        F.sum(F.size("factors").cast("long")).alias("factors"),
    )


@query(
    "prediction_page",
    """SELECT id, entity_id, score, risk, (SELECT count(*) FROM predictions_t WHERE risk <> 'low' AND
         contains(lower(concat_ws(' ', object_name, entity_id, sensor_type, system_type, sensor_name, system_tag)), 'asia')
         AND risk = 'high') AS total
       FROM predictions_t WHERE risk = 'high' AND
         contains(lower(concat_ws(' ', object_name, entity_id, sensor_type, system_type, sensor_name, system_tag)), 'asia')
       ORDER BY score DESC, prediction_time DESC, id LIMIT 20 OFFSET 10""",
)
def _(spark, sf):
    active = K.active(stored(spark, sf), MODELS, latest=False)
    total, page = K.prediction_page(active, 20, 10, risk="high", term="ASIA")
    return page.select("id", "entity_id", "score", "risk", F.lit(total).cast("long").alias("total"))


_PAGE = "SELECT id, score, risk FROM predictions_t ORDER BY score DESC NULLS LAST, prediction_time DESC, id LIMIT 20 OFFSET "


@query("ranked_pages", _PAGE + "150")
def _(spark, sf):
    """A deep page of the list written in its order."""
    path = scratch_path(spark, "ranked")
    K.write_ranked(predictions(spark, sf), path, rows=100)
    return K.ranked_page(spark, path, 20, 150, rows=100).select("id", "score", "risk")


@query("page_after", _PAGE + "150")
def _(spark, sf):
    """The page that follows the 150th record."""
    whole = predictions(spark, sf)
    path = scratch_path(spark, "ranked")
    K.write_ranked(whole, path)
    last = K.ranked_page(spark, path, 1, 149).first()
    after = (last["score"], last["prediction_time"], last["id"])
    return K.page_after(whole, after, 20).select("id", "score", "risk")


def tickets(spark, sf):
    """Tickets of earlier days: a closed one for each high risk of the smoke-free system."""
    high = predictions(spark, sf).where("risk = 'high' AND system_type IN ('ASIA', 'EUROPE')")
    moment = F.col("prediction_time")
    per_entity = high.groupBy("entity_id").agg(
        F.max_by("id", "prediction_time").alias("prediction_id"),
        F.max_by("system_type", "prediction_time").alias("system_type"),
        F.max(moment).alias("created_at"),
    )
    return per_entity.select(
        F.col("entity_id").cast("long").alias("id"),
        "prediction_id",
        F.when(F.col("system_type") == "ASIA", "new").otherwise("done").alias("status"),
        "created_at",
        F.col("created_at").alias("updated_at"),
        F.lit("").alias("comment"),
        F.lit(0).alias("automatic"),
    )


part(
    "tickets_t",
    """SELECT entity_id::BIGINT AS id, arg_max(id, prediction_time) AS prediction_id,
         if(arg_max(system_type, prediction_time) = 'ASIA', 'new', 'done') AS status, max(prediction_time) AS created_at
       FROM predictions_t WHERE risk = 'high' AND system_type IN ('ASIA', 'EUROPE') GROUP BY entity_id""",
)


@query(
    "new_tickets",
    """SELECT id AS prediction_id, 'new' AS status, 1 AS automatic,
         row_number() OVER (ORDER BY md5(id)[1:3], id) + (SELECT max(id) FROM tickets_t) AS id
       FROM predictions_t p WHERE risk = 'high' AND id NOT IN (SELECT prediction_id FROM tickets_t WHERE status = 'new')""",
)
def _(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    found = K.new_tickets(predictions(spark, sf), tickets(spark, sf), now)
    return found.select("prediction_id", "status", "automatic", "id")


def _requests(spark, sf):
    word = F.col("status")
    wanted = (
        F.when(word == "done", "new").when(F.col("id") < 50, "done").otherwise("in_progress")
    )
    return tickets(spark, sf).select(
        "id",
        wanted.alias("status"),
        F.lit("checked").alias("comment"),
        F.lit("2024-02-02 00:00:00").cast("timestamp_ntz").alias("at"),
    )


@query(
    "ticket_changes",
    """SELECT id, prediction_id, if(status = 'new' AND id >= 50, 'in_progress', status) AS status,
       if(status = 'new' AND id >= 50, 'checked', '') AS comment,
       if(status = 'new' AND id >= 50, TIMESTAMP '2024-02-02', created_at) AS updated_at FROM tickets_t""",
)
def _(spark, sf):
    changed, _refused = K.apply_changes(tickets(spark, sf), _requests(spark, sf))
    return changed.select("id", "prediction_id", "status", "comment", "updated_at")


@query(
    "refused_changes",
    """SELECT id, if(status = 'done', 'new', 'done') AS wanted, 'status change not allowed' AS reason FROM tickets_t
       WHERE status = 'done' OR id < 50""",
)
def _(spark, sf):
    return K.apply_changes(tickets(spark, sf), _requests(spark, sf))[1]


@query(
    "refused_tickets",
    "SELECT id AS prediction_id, 'no score' AS reason FROM predictions_t WHERE score IS NULL",
)
def _(spark, sf):
    found = predictions(spark, sf)
    return K.refused_tickets(found.select(F.col("id").alias("prediction_id")), found)


@query(
    "ticket_details",
    """SELECT t.id, t.prediction_id, t.status, p.entity_id, p.object_name, p.score, p.risk FROM tickets_t t
       JOIN predictions_t p ON p.id = t.prediction_id""",
)
def _(spark, sf):
    found = K.ticket_details(tickets(spark, sf), predictions(spark, sf))
    return found.select(
        "id", "prediction_id", "status", "entity_id", "object_name", "score", "risk"
    )


@query(
    "alert_cards",
    """SELECT entity_id, card, min(t) AS first_alert, max(t) AS last_alert, count(*) AS alerts FROM
       (SELECT entity_id, t, count(*) FILTER (WHERE fresh) OVER (PARTITION BY entity_id ORDER BY t) AS card FROM
         (SELECT entity_id, prediction_time AS t, coalesce(date_diff('day', lag(prediction_time)
            OVER (PARTITION BY entity_id ORDER BY prediction_time), prediction_time) > 1, true) AS fresh
          FROM predictions_t WHERE risk = 'high')) GROUP BY ALL""",
)
def _(spark, sf):
    return K.alert_cards(predictions(spark, sf).where("risk = 'high'"))


@query(
    "dashboard_kpis",
    """SELECT count(*) AS channels, count(*) FILTER (WHERE risk = 'high') AS high_risk,
       count(*) FILTER (WHERE risk = 'unavailable') AS unavailable,
       count(*) FILTER (WHERE direction = 'sensor') AS sensor_total,
       count(*) FILTER (WHERE direction = 'sensor' AND risk = 'high') AS sensor_high,
       count(*) FILTER (WHERE direction = 'infrastructure') AS infrastructure_total,
       count(*) FILTER (WHERE direction = 'infrastructure' AND risk = 'high') AS infrastructure_high,
       0::BIGINT AS smoke_total, 0::BIGINT AS smoke_high,
       (SELECT count(*) FROM tickets_t WHERE status = 'new') AS open_tickets FROM latest_t""",
)
def _(spark, sf):
    return K.kpis(K.active(predictions(spark, sf), MODELS), tickets(spark, sf))


@query(
    "risk_trend",
    """SELECT strftime(prediction_time, '%Y-%m-%d') AS date, count(*) AS total,
       count(*) FILTER (WHERE risk = 'high' AND direction = 'sensor') AS sensor,
       count(*) FILTER (WHERE risk = 'high' AND direction = 'infrastructure') AS infrastructure, 0::BIGINT AS smoke
       FROM predictions_t WHERE prediction_time >= (SELECT max(prediction_time) - INTERVAL 9 DAY FROM predictions_t)
       GROUP BY 1""",
)
def _(spark, sf):
    return K.trend(K.active(stored(spark, sf), MODELS, latest=False), days=10)


part(
    "objects_t",
    """SELECT n_nationkey::VARCHAR AS object_id, n_name AS object_name, count(p.id) AS channels,
       count(*) FILTER (WHERE p.risk = 'high') AS high_risk, max(p.score) AS max_score
       FROM nation LEFT JOIN latest_t p ON p.object_id = n_nationkey::VARCHAR WHERE n_nationkey % 5 <> 0 GROUP BY ALL""",
)


@query("objects_with_risk", "SELECT * FROM objects_t")
def _(spark, sf):
    return K.by_object(_objects(spark, sf), K.active(predictions(spark, sf), MODELS))


@query(
    "site_ranking",
    "SELECT * FROM objects_t ORDER BY high_risk DESC, coalesce(max_score, -1) DESC, object_id LIMIT 5",
)
def _(spark, sf):
    found = K.by_object(_objects(spark, sf), K.active(predictions(spark, sf), MODELS))
    return K.site_ranking(found)


@query(
    "data_quality",
    """SELECT max(prediction_time) AS snapshot_time, count(*) AS scoring_rows, count(*) FILTER (WHERE eligible) AS eligible_rows,
       count(*) FILTER (WHERE NOT eligible) AS unavailable_rows FROM rows_t""",
)
def _(spark, sf):
    return K.data_quality(rows(spark, sf))


@query(
    "direction_coverage",
    """SELECT direction, sensor_type, count(DISTINCT entity_id) AS channels, count(*) FILTER (WHERE eligible) AS eligible
       FROM rows_t GROUP BY ALL""",
)
def _(spark, sf):
    return K.direction_coverage(rows(spark, sf))


@query(
    "publication_metadata",
    """SELECT count(*) AS rows, count(DISTINCT entity_id) AS channels, 0::BIGINT AS rows_without_channel,
       count(DISTINCT object_id) FILTER (WHERE object_id NOT IN (SELECT object_id FROM objects_t)) AS objects_without_name,
       (SELECT count(DISTINCT channel_id) FROM panel_t) AS snapshot_channels,
       (SELECT count(DISTINCT channel_id) FROM panel_t) - count(DISTINCT entity_id) AS excluded_snapshot_channels FROM rows_t""",
)
def _(spark, sf):
    snapshot = B.panel(spark, sf).select("channel_id").distinct()
    return K.publication_metadata(
        rows(spark, sf), snapshot, _channels(spark, sf), _objects(spark, sf)
    )


part(
    "observations_t",
    """SELECT day AS date, sum(events)::BIGINT AS events, sum(alarms)::BIGINT AS alarms,
       sum(fault_messages)::BIGINT AS fault_messages, count(*) AS active_channels,
       sum(if(regexp_matches(lower(c.sensor_type), 'auto|build|house'), fault_messages, 0))::BIGINT AS sensor,
       sum(if(regexp_matches(lower(c.sensor_type), 'mach|^furn'), fault_messages, 0))::BIGINT AS infrastructure,
       count(*) FILTER (WHERE c.channel_key IS NULL) AS unmapped_channel_days
       FROM daily_t LEFT JOIN channels_t c
         ON c.channel_key::VARCHAR = channel_id WHERE day < DATE '2024-01-26' GROUP BY 1""",
)


@query("daily_observations", "SELECT * REPLACE (date::TIMESTAMP AS date) FROM observations_t")
def _(spark, sf):
    known = B.channels(spark, sf).select(
        F.col(fv.CHANNEL_KEY).cast("string").alias("channel_id"),
        F.col(fv.SENSOR_TYPE).alias("sensor_type"),
    )
    patterns = {k: DIRECTIONS[k] for k in ("sensor", "infrastructure")}
    until = F.lit("2024-01-26").cast("date")
    return K.daily_observations(B.daily(spark, sf), known, until, patterns)


@query(
    "observation_history",
    """SELECT d AS date, o.n AS orders FROM
       (SELECT unnest(generate_series(max(o_orderdate) - INTERVAL 99 DAY, max(o_orderdate), INTERVAL 1 DAY)) AS d
        FROM orders) LEFT JOIN
       (SELECT o_orderdate AS t, count(*) AS n FROM orders GROUP BY 1) o
       ON o.t = d""",
)
def _(spark, sf):
    days = B.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("orders"))
    return C.observation_history(days, 100)


@query(
    "request_checks",
    """SELECT 0::BIGINT AS missing_ids, count(*) FILTER (WHERE prediction_time <> date_trunc('day', prediction_time)) AS not_midnight,
       count(*) - count(DISTINCT (entity_id, prediction_time)) AS duplicate_keys,
       count(*) FILTER (WHERE NOT regexp_matches(lower(sensor_type), 'auto|build|house')) AS wrong_sensor_type,
       count(*) FILTER (WHERE eligible AND last_explicit_state <> 'view') AS eligible_not_normal,
       count(*) FILTER (WHERE eligible AND last_state_ts >= prediction_time) AS state_not_before FROM rows_t""",
)
def _(spark, sf):
    return Q.request_problems(rows(spark, sf), DIRECTIONS["sensor"], B.WORDS.normal)


_EXPORT = ", ".join(
    f"""CASE WHEN regexp_matches({c}, '^[=+\\-@]') THEN '''' || {c} ELSE {c} END AS {c}"""
    if c not in ("prediction_time", "target_start", "target_end", "score")
    else c
    for c in fv.EXPORT_FIELDS
)


@query(
    "export_rows",
    f"SELECT {_EXPORT} FROM (SELECT * REPLACE ('=' || sensor_name AS sensor_name) FROM latest_t)",
)
def _(spark, sf):
    latest = K.active(predictions(spark, sf), MODELS)
    return T.export_rows(latest.withColumn("sensor_name", F.concat(F.lit("="), "sensor_name")))


@query(
    "export_file",
    """SELECT id, strftime(prediction_time, '%Y-%m-%dT%H:%M:%S') AS prediction_time, '''=' || sensor_name AS sensor_name FROM latest_t""",
)
def _(spark, sf):
    path = scratch_path(spark, "export")
    latest = K.ranked(K.active(predictions(spark, sf), MODELS))
    T.export_csv(latest.withColumn("sensor_name", F.concat(F.lit("="), "sensor_name")), path)
    return spark.read.option("header", True).csv(path).select(
        "id", "prediction_time", "sensor_name"
    )


@query(
    "ranked_predictions",
    "SELECT id, score, risk FROM latest_t",
)
def _(spark, sf):
    """The whole list, highest score first."""
    return K.ranked(K.active(predictions(spark, sf), MODELS)).select("id", "score", "risk")


@query("top_predictions", "SELECT id, score, risk FROM latest_t ORDER BY score DESC NULLS LAST, id LIMIT 6")
def _(spark, sf):
    """The six rows that head the dashboard."""
    return K.ranked(K.active(predictions(spark, sf), MODELS)).limit(6).select("id", "score", "risk")


@query(
    "reproducible_ids",
    """SELECT substr(sha256(concat_ws('|', o_orderstatus, o_custkey::VARCHAR, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'))), 1, 24) AS id,
       o_orderkey FROM orders""",
)
def _(spark, sf):
    identity = S.surrogate_id(
        F.col("o_orderstatus"), F.col("o_custkey").cast("string"), S.iso_text(F.col("o_orderdate"))
    )
    return B.table(spark, sf, "orders").select(identity.alias("id"), "o_orderkey")
