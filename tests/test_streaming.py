import datetime as dt

from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.operators import calendar as C
from vigil.operators import states as ST
from vigil.streaming import incremental as I

SCHEMA = (
    "event_id string, channel_id string, raw_date string, raw_time string, alarm_raw string,"
    " value_raw string, ts timestamp_ntz, alarm boolean, num double, nonfinite boolean, state string"
)


def journal(spark):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(200):
        t = start + dt.timedelta(minutes=17 * i if i % 3 else 17 * i - 10)
        text = (str(i), "ab"[i % 2], str(t.date()), str(t.time()), "t", str(i))
        rows.append((*text, t, i % 4 == 0, float(i), False, "неисправен" if i % 5 == 0 else None))
    return spark.createDataFrame(rows + rows[:20], SCHEMA)


def run(spark, df, name, tmp_path):
    query = (
        df.writeStream.format("memory")
        .queryName(name)
        .outputMode("complete" if name != "copies" else "append")
        .option("checkpointLocation", f"{tmp_path}/{name}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    return spark.table(name)


def same(left, right):
    columns = right.columns
    return sorted(map(tuple, left.select(*columns).collect()), key=str) == sorted(
        map(tuple, right.collect()), key=str
    )


def test_stream_equals_batch(spark, tmp_path):
    rows = journal(spark)
    path = f"{tmp_path}/journal"
    rows.repartition(3).write.parquet(path)
    stream = I.journal_stream(spark, path, rows.schema, 1)

    counts = run(spark, I.daily_counts(stream), "counts", tmp_path)
    batch = C.daily_aggregate(rows).select(
        "channel_id", "day", "events", "alarms", "fault_messages", "numeric_n", "numeric_max"
    )
    assert same(counts, batch)

    copies = run(spark, I.suppress_copies(stream, "40 days"), "copies", tmp_path)
    assert copies.count() == 200 == I.suppress_copies(rows).count()


def test_session_windows_equal_gap_sessions(spark):
    rows = journal(spark)
    found = I.sessions(rows, 30).select("channel_id", "start_ts", "end_ts", "messages")
    batch = ST.gap_sessions(rows, gap_minutes=30)
    assert same(found, batch.select("channel_id", "start_ts", "end_ts", "messages"))


def closed_runs(rows, until):
    line = ST.timeline(rows.where(F.col("ts") <= F.lit(until)))
    closed = line.where("next_change_ts IS NOT NULL").select("channel_id", F.col("ts").alias("start_ts"))
    return ST.episodes(line).join(closed, ["channel_id", "start_ts"])


def test_many_micro_batches_equal_one_batch(spark, tmp_path):
    rows = journal(spark).withColumn("state", F.coalesce("state", F.lit(fv.NORMAL)))
    moments = [dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 6)]
    cuts = [dt.datetime(2023, 1, 1), *moments, dt.datetime(2025, 1, 1)]

    def go_on(parts):
        for a, b in parts:
            part = rows.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)))
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/stated")
        stream = I.journal_stream(spark, f"{tmp_path}/stated", rows.schema, 1)
        return I.follow_episodes(I.state_instants(stream, "1 hour"), f"{tmp_path}/runs", f"{tmp_path}/log")

    steps = list(zip(cuts, cuts[1:]))
    go_on(steps[:3])
    found = go_on(steps[3:])  # goes on where the first run stopped
    assert spark.read.parquet(f"{tmp_path}/runs/carried").select("batch").distinct().count() > 3
    until = rows.agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]
    batch = closed_runs(rows, until).select(found.columns)
    assert batch.count() > 5 and same(found, batch)
