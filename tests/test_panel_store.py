import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigil.operators import calendar as C
from vigil.operators import panel as P
from vigil.operators import panel_store as PS
from vigil.operators import states as ST
from vigil.plans import bindings as B

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    """Journal of many days, some of them silent: the days of the given events moved apart."""
    moved = B.journal(spark, DATA)
    number = F.pmod(F.xxhash64("event_id"), F.lit(60)).cast("int")
    gap = F.when(number >= 20, 4).otherwise(0) + F.when(number >= 40, 37).otherwise(0)
    ts = F.col("ts") + F.make_dt_interval(number + gap, F.pmod(F.xxhash64("ts", "event_id"), F.lit(24)).cast("int"))
    return moved.withColumn("ts", F.date_trunc("hour", ts).cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def full(spark, events):
    return P.build(
        C.daily_aggregate(events, B.WORDS),
        C.dense_coverage(C.day_coverage(events)),
        ST.timeline(events, [B.WORDS.fault, B.WORDS.normal]),
        B.metadata(spark, DATA),
        words=B.WORDS,
        min_history_days=3,
    )


def rows(df):
    shown = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    return sorted(map(tuple, df.select(*shown).collect()), key=repr)


def stored(spark, root, events, cuts):
    store = PS.PanelStore(str(root), B.WORDS, min_history_days=3)
    for a, b in zip(cuts, cuts[1:]):
        day = F.to_date("ts")
        PS.append_days(store, events.where((day >= a) & (day < b)))
    return store


def test_batches_of_days_give_the_panel_of_a_full_build(spark, events, full, tmp_path):
    first, last = events.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    cuts = [first + dt.timedelta(n) for n in (0, 1, 2, 22, 45, 90)] + [last + dt.timedelta(1)]
    store = stored(spark, tmp_path / "store", events, cuts)
    meta = B.metadata(spark, DATA)
    expected = rows(full)
    assert len(expected) > 500 and rows(PS.panel(spark, store, meta)) == expected
    since = first + dt.timedelta(80)
    part = PS.panel(spark, store, meta, since)
    assert rows(part) == [r for r in expected if r[1] >= dt.datetime.combine(since, dt.time())]
    # the last batch again, and a batch before the end
    again = events.where(F.to_date("ts") >= cuts[-2])
    PS.append_days(store, again)
    assert rows(PS.panel(spark, store, meta)) == expected
    with pytest.raises(ValueError):
        PS.append_days(store, events.where(F.to_date("ts") == first))
    assert PS.append_days(store, events.where("false")) is None


def test_old_days_are_not_scanned(spark, events, tmp_path, monkeypatch):
    first = events.agg(F.to_date(F.min("ts"))).first()[0]
    cuts = [first, first + dt.timedelta(50), first + dt.timedelta(70)]
    stored(spark, tmp_path / "store", events, cuts)
    plans = []
    write = PS.overwrite_partitions
    monkeypatch.setattr(
        PS, "overwrite_partitions", lambda df, path, by: (plans.append((path, df)), write(df, path, by))[1]
    )
    store = PS.PanelStore(str(tmp_path / "store"), B.WORDS, min_history_days=3)
    PS.append_days(store, events.where(F.to_date("ts").between(cuts[-1], cuts[-1] + dt.timedelta(3))))
    (rolled,) = [df for path, df in plans if path.endswith("rolled")]
    plan = rolled._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and f">= {cuts[-1] - dt.timedelta(29)}" in plan.replace("day#", "")
