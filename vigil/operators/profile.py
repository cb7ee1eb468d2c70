"""Reports on journals, channels, features and plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import fixed_values as fv
from vigil.functions import scalars as S
from vigil.operators.ordered import FIRST
from vigil.operators.quantiles import exact_quantiles, with_quantiles
from vigil.operators.ranges import running
from vigil.session import materialize


def observed_states(events: DataFrame, year: Column) -> DataFrame:
    """Messages and channels per type, state and alarm flag.

    The first step reduces to the channel, so the distinct count is a plain one.
    """
    text = events.where(F.col("state").isNotNull()).withColumn("year", year)
    keys = ["year", "sensor_type", "state", "alarm"]
    per_channel = text.groupBy(*keys, "channel_id").agg(F.count("*").alias("_n"))
    return per_channel.groupBy(*keys).agg(
        F.sum("_n").alias("events"), F.count("channel_id").alias("channels")
    )


def channel_years(events: DataFrame, year: Column) -> DataFrame:
    """Activity of each channel per year.

    Values are counted per distinct number first, which spreads a hot channel
    over its values; the dictionary attributes take the smallest text, since a
    first one would depend on the order.
    """
    keys = ["year", "channel_id"]
    per_value = (
        events.withColumn("year", year)
        .groupBy(*keys, "num")
        .agg(
            F.min("ts").alias("_lo"),
            F.max("ts").alias("_hi"),
            F.count("*").alias("_n"),
            S.count_if(F.col("alarm")).alias("_alarms"),
            F.min("sensor_type").alias("_type"),
            F.min("object_id").alias("_object"),
        )
    )
    return per_value.groupBy(*keys).agg(
        F.min("_lo").alias("first_ts"),
        F.max("_hi").alias("last_ts"),
        F.sum("_n").alias("events"),
        F.sum("_alarms").alias("alarms"),
        F.min("_type").alias("sensor_type"),
        F.min("_object").alias("object_id"),
        F.coalesce(F.sum(F.when(F.col("num").isNotNull(), F.col("_n"))), F.lit(0)).alias(
            "numeric_n"
        ),
        F.min("num").alias("numeric_min"),
        F.max("num").alias("numeric_max"),
        F.count("num").alias("numeric_distinct"),
    )


def composition(years: DataFrame) -> DataFrame:
    """New and vanished channels and the share of the loudest ones per year.

    ``years`` has a row per channel and year.  Looking at the neighbour years of
    one channel replaces a comparison of whole channel sets.
    """
    line = Window.partitionBy("channel_id").orderBy("year")
    rank = Window.partitionBy("year").orderBy(F.desc("events"), "channel_id")
    seen = years.select("channel_id", "year", "events").withColumns(
        {
            "_new": F.coalesce(F.lag("year").over(line) != F.col("year") - 1, F.lit(True)),
            "_gone": F.coalesce(F.lead("year").over(line) != F.col("year") + 1, F.lit(True)),
        }
    )
    totals = seen.groupBy("year").agg(
        F.count("channel_id").alias("channels"),
        S.count_if(F.col("_new")).alias("_new"),
        S.count_if(F.col("_gone")).alias("_gone"),
        F.sum("events").alias("_events"),
        F.max("events").alias("_top1"),
    )
    # The filter on the row number lets Spark keep ten rows per task and year.
    top = (
        years.select("year", "channel_id", "events")
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") <= 10)
        .groupBy("year")
        .agg(F.sum("events").alias("_top10"))
    )
    # One row per year.
    calendar = Window.orderBy("year")
    before = F.lag("year").over(calendar)
    return (
        totals.join(top, "year")
        .withColumns({"_prev": before, "_left": F.lag("_gone").over(calendar)})
        .select(
            "year",
            "channels",
            F.when(F.col("_prev").isNotNull(), F.col("_new")).alias("new_vs_previous_year"),
            F.when(F.col("_prev").isNotNull(), F.col("_left")).alias(
                "disappeared_vs_previous_year"
            ),
            (F.col("_top1") / F.col("_events")).alias("top1_event_share"),
            (F.col("_top10") / F.col("_events")).alias("top10_event_share"),
        )
    )


def type_years(years: DataFrame) -> DataFrame:
    return years.groupBy("year", "sensor_type").agg(
        F.sum("events").alias("events"),
        F.sum("alarms").alias("alarms"),
        F.count("*").alias("channels"),
    )


def numeric_types(years: DataFrame) -> DataFrame:
    """Channels with numbers and constant ones among them, per year and type."""
    numeric = years.where(F.col("numeric_n") > 0)
    return numeric.groupBy("year", "sensor_type").agg(
        F.count("*").alias("numeric_channels"),
        S.count_if(F.col("numeric_distinct") == 1).alias("constant_channels"),
        F.sum("numeric_n").alias("numeric_n"),
        F.min("numeric_min").alias("min_observed"),
        F.max("numeric_max").alias("max_observed"),
    )


def unknown_channels(years: DataFrame) -> DataFrame:
    return years.where(F.col("sensor_type").isNull())


def state_semantics(observed: DataFrame, lookup: DataFrame) -> DataFrame:
    """Alarm rate of each (type, state) and whether the dictionary knows it."""
    totals = observed.groupBy("sensor_type", "state").agg(
        F.sum("events").alias("events"),
        F.coalesce(F.sum(F.when(F.col("alarm"), F.col("events"))), F.lit(0)).alias("alarm_events"),
    )
    joined = totals.join(lookup, ["sensor_type", "state"], "left")
    return joined.withColumns(
        {
            "observed_alarm_rate": F.col("alarm_events") / F.col("events"),
            "not_in_dictionary": F.col("n_sets").isNull(),
        }
    )


def pivot_sum(
    df: DataFrame, index: str, columns: str, value: Column, names: Sequence[str]
) -> DataFrame:
    """Pivot with the columns named beforehand, zero where nothing was seen."""
    wide = df.groupBy(index).pivot(columns, list(names)).agg(F.sum(value))
    return wide.fillna(0, list(names))


def episode_summary(runs: DataFrame) -> DataFrame:
    """Episodes per year with censoring and the median closed duration."""
    yearly = runs.withColumn("year", F.year("start_ts"))
    counts = yearly.groupBy("year").agg(
        F.count("*").alias("episodes"),
        S.count_if(F.col("observed_start")).alias("observed_starts"),
        F.count_distinct("channel_id").alias("channels"),
        S.count_if(F.col("left_censored")).alias("left_censored"),
        S.count_if(F.col("right_censored")).alias("right_censored"),
    )
    return with_quantiles(counts, yearly, ["year"], "duration_hours", {"median_closed_hours": 0.5})


def duration_sensitivity(runs: DataFrame) -> DataFrame:
    hours = F.col("duration_hours")
    return runs.groupBy(F.year("start_ts").alias("year")).agg(
        F.count("*").alias("episodes"),
        F.count("duration_hours").alias("closed"),
        S.count_if(hours <= 1 / 60).alias("closed_at_most_1min"),
        S.count_if(hours >= 5 / 60).alias("closed_at_least_5min"),
        S.count_if(hours >= 1).alias("closed_at_least_1h"),
    )


def episode_semantics(runs: DataFrame, meta: DataFrame, short_hours: float) -> DataFrame:
    """Share of short episodes and the median length per current type."""
    confirmed = runs.where("observed_start").join(meta, "channel_id", "left")
    hours = F.col("duration_hours")
    counts = confirmed.groupBy("sensor_type_current").agg(
        F.count("*").alias("episodes"),
        F.count("duration_hours").alias("closed_episodes"),
        F.avg((hours <= short_hours).cast("int")).alias("short_share_closed"),
    )
    return with_quantiles(counts, confirmed, ["sensor_type_current"], "duration_hours", {"median_hours": 0.5})


def starts_by_hour(runs: DataFrame) -> DataFrame:
    confirmed = runs.where("observed_start")
    return confirmed.groupBy(F.hour("start_ts").alias("hour")).agg(F.count("*").alias("starts"))


def duration_histogram(runs: DataFrame, bins_per_decade: int = 5) -> DataFrame:
    """Closed durations in seconds by logarithmic bins."""
    seconds = F.greatest(F.col("duration_hours") * 3600, F.lit(1.0))
    closed = runs.where(F.col("duration_hours").isNotNull())
    bin_number = F.floor(F.log10(seconds) * bins_per_decade).cast("int")
    return closed.groupBy(bin_number.alias("bin")).agg(F.count("*").alias("episodes"))


def feature_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing, range, mean, median and p99 of every feature; quantiles are exact and interpolated."""
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [], list(features), "feature", "value"
    )
    value = F.col("value")
    usable = F.coalesce(S.is_finite(value), F.lit(False))
    profile = long.groupBy("feature").agg(
        F.count("*").alias("rows"),
        S.count_if(~usable).alias("missing_or_nonfinite"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
    )
    profile = with_quantiles(profile, long.where(usable), ["feature"], "value", {"median": 0.5, "p99": 0.99})
    return profile.select(
        "feature",
        "rows",
        "missing_or_nonfinite",
        "min",
        "max",
        "mean",
        "median",
        "p99",
        (F.col("missing_or_nonfinite") / F.col("rows")).alias("missing_rate"),
        (F.col("min").isNull() | (F.col("min") == F.col("max"))).alias("constant_or_empty"),
    )


def null_and_constant(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features with gaps and features with a single value, one wide aggregate."""
    cells = []
    for f in features:
        cells += [F.count(f).alias(f"n_{f}"), F.approx_count_distinct(f).alias(f"d_{f}")]
    wide = df.agg(F.count("*").alias("rows"), *cells)
    items = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                (F.col(f"n_{f}") < F.col("rows")).alias("has_nulls"),
                (F.col(f"d_{f}") <= 1).alias("is_constant"),
            )
            for f in features
        ]
    )
    return wide.select(F.inline(items))


def drift(rows: DataFrame, label: str, by: str = "split") -> DataFrame:
    """Unseen channels and objects, mean activity and prevalence per split.

    Expects the flags ``new_channel`` and ``new_object``.
    """
    return rows.groupBy(by).agg(
        F.count("*").alias("rows"),
        S.count_if(F.col("new_channel")).alias("new_channel_rows"),
        S.count_if(F.col("new_object")).alias("new_object_rows"),
        F.avg("events_7d").alias("mean_events_7d"),
        F.avg("alarms_7d").alias("mean_alarms_7d"),
        F.avg(F.col(label).cast("double")).alias("prevalence"),
    )


def target_rate(rows: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.sum(F.col(label).cast("long")).alias("positives"),
        F.avg(F.col(label).cast("double")).alias("prevalence"),
    )


def hypotheses(rows: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Target rate with and without past messages of each kind, in one pass."""
    wide = rows.select("channel_id", F.col(label).cast("long").alias("_y"), *features)
    long = wide.unpivot(["channel_id", "_y"], list(features), "feature", "value")
    flagged = long.withColumn("present", F.coalesce(F.col("value") > 0, F.lit(False)))
    per_channel = flagged.groupBy("feature", "present", "channel_id").agg(
        F.count("*").alias("_n"), F.sum("_y").alias("_pos")
    )
    return per_channel.groupBy("feature", "present").agg(
        F.sum("_n").alias("rows"),
        F.count("channel_id").alias("channels"),
        F.sum("_pos").alias("positives"),
        (F.sum("_pos") / F.sum("_n")).alias("target_rate"),
    )


def concentration(rows: DataFrame, label: str) -> DataFrame:
    """Examples and positives per channel."""
    return rows.groupBy("channel_id").agg(
        F.count("*").alias("examples"), F.sum(F.col(label).cast("long")).alias("positives")
    )


def top_share(per_channel: DataFrame, n: int = 10) -> DataFrame:
    """Share of all positives that the first ``n`` channels hold."""
    top = per_channel.orderBy(F.desc("positives"), "channel_id").limit(n)
    some = top.agg(F.sum("positives").alias("_top")).withColumn("_one", F.lit(1))
    whole = per_channel.agg(F.sum("positives").alias("_all")).withColumn("_one", F.lit(1))
    share = F.col("_top") / F.greatest(F.col("_all"), F.lit(1))
    return some.join(whole, "_one").select(share.alias("top_share"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation and quantiles of the given columns."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quantiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return with_quantiles(stats, long, ["column"], "value", quantiles)


def outlier_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of values outside 1.5 interquartile ranges; nothing is removed."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    # One row per column name.
    bounds = F.broadcast(exact_quantiles(long, ["column"], "value", [0.25, 0.75]).withColumnRenamed("quantiles", "_q"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    reach = (high - low) * 1.5
    outside = (F.col("value") < low - reach) | (F.col("value") > high + reach)
    return (
        long.join(bounds, "column")
        .groupBy("column")
        .agg(
            F.max(low).alias("q1"),
            F.max(high).alias("q3"),
            F.max(high - low).alias("iqr"),
            (F.lit(100.0) * S.count_if(outside) / F.count("value")).alias("outside_percent"),
        )
    )


#: Values that own at least one row in so many are looked up by broadcast: at most so many a column.
FREQUENT = 1000


def rank_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average rank of every distinct value of every column, and whether the value is frequent.

    Distinct values with their counts are cut into ranges of about equal size;
    running counts that carry on from piece to piece give the rank, so no task
    sorts a whole column and the pieces grow with the data.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    counts = long.groupBy("column", "value").agg(F.count("*").alias("_n"))
    run = running(counts, ["column"], [F.asc("value")], {"_cum": F.col("_n")}, {"_all": "_cum"})
    rank = F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0)
    return run.select("column", "value", rank.alias("rank"), (F.col("_n") * FREQUENT >= F.col("_all")).alias("frequent"))


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of columns over rows without gaps.

    Ranks come back to the rows by value.  Frequent values, which would be hot
    keys of a join, are at most ``FREQUENT`` a column and are broadcast; their
    rows are spread over all partitions of the join that serves the others.
    """
    whole = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    ranks = materialize(rank_table(whole, columns), "ranks")
    ranked = whole
    for c in columns:
        mine = ranks.where(F.col("column") == c)
        often = mine.where("frequent").select(F.col("value").alias(c), F.col("rank").alias("_often"))
        ranked = ranked.join(F.broadcast(often), c, "left")
        spread = F.when(F.col("_often").isNotNull(), 1 + F.pmod(F.xxhash64(*columns), F.lit(1 << 20))).otherwise(F.lit(0))
        rare = mine.where("not frequent").select(
            F.col("value").alias(c), F.lit(0).cast("long").alias("_spread"), F.col("rank").alias("_rare")
        )
        ranked = ranked.withColumn("_spread", spread).join(rare, [c, "_spread"], "left")
        ranked = ranked.withColumn(f"r_{c}", F.coalesce("_often", "_rare")).drop("_often", "_rare", "_spread")
    pairs = [(a, b) for a in columns for b in columns]
    wide = ranked.agg(
        *[F.corr(f"r_{a}", f"r_{b}").alias(f"{i}") for i, (a, b) in enumerate(pairs)]
    )
    items = F.array(
        *[
            F.struct(
                F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{i}`").alias("spearman")
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(F.inline(items))


def plan_counts(monthly_plan: DataFrame, actions: Sequence[str] = fv.PLAN_ACTIONS) -> DataFrame:
    """Planned jobs per month and action."""
    return pivot_sum(monthly_plan, "month", "action", F.lit(1), actions)


def equipment_without_marks(equipment: DataFrame, monthly_plan: DataFrame) -> DataFrame:
    return equipment.join(monthly_plan.select("source_row").distinct(), "source_row", "left_anti")


def match_objects(plan: DataFrame, objects: DataFrame, name: str) -> DataFrame:
    """Flag of plan rows whose label is exactly the name of an object."""
    known = objects.select(F.col(name).alias("object_label")).distinct()
    marked = plan.join(known.withColumn("_known", F.lit(True)), "object_label", "left")
    return marked.withColumn("exact_name_match", F.col("_known").isNotNull()).drop("_known")


def top_rows(df: DataFrame, column: str, n: int, *ties: str, smallest: bool = False) -> DataFrame:
    order = F.asc_nulls_last(column) if smallest else F.desc_nulls_last(column)
    return df.orderBy(order, *ties).limit(n)


def feature_dictionary(panel: DataFrame, training: Column | None = None, windows: Sequence[int] = fv.PANEL_WINDOWS) -> DataFrame:
    """Role, type, meaning, gaps and use of every column of a panel, one row a column.

    ``use_default`` marks features with at least two values in the rows that
    ``training`` chooses (all rows unless given).  A column without a known
    meaning is a diagnostic with a NULL definition.  All counts come from one
    aggregate of one row, which is then opened.
    """
    chosen = F.lit(True) if training is None else training
    features = {f"{m}_{w}d": f"{text} за предыдущие {w} суток" for m, text in fv.MEASURE_TEXT.items() for w in windows}
    features |= fv.EXTRA_TEXT
    cells, items = [F.count("*").alias("_rows")], []
    for n, (c, kind) in enumerate(panel.dtypes):
        value, role = F.col(f"`{c}`"), "metadata_or_diagnostic"
        if c in features:
            role = "feature"
        elif c.startswith("target_fault"):
            role = "label"
        trained = F.when(chosen, value)
        cells.append(
            F.struct(
                F.count(value).alias("filled"),
                F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias("constant"),
                F.coalesce(F.min(trained) != F.max(trained), F.lit(False)).alias("trained"),
            ).alias(f"_{n}")
        )
        items.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(role).alias("role"),
                F.lit(kind).alias("dtype"),
                F.lit(features.get(c, fv.OTHER_TEXT.get(c))).cast("string").alias("definition"),
                F.lit(fv.KNOWN_BEFORE if role == "feature" else fv.KNOWN_LATER).alias("available_at"),
                (F.col(f"_{n}.trained") & F.lit(role == "feature")).alias("use_default"),
                F.col("_rows").alias("rows"),
                (F.col(f"_{n}.filled") < F.col("_rows")).alias("has_nulls"),
                F.col(f"_{n}.constant").alias("is_constant"),
            )
        )
    # With inline, Spark 4.1.2 returned no row for a small panel (see the test); explode returns all.
    return panel.agg(*cells).select(F.explode(F.array(*items)).alias("_item")).select("_item.*")
