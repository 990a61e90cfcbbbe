"""The record of events: typed projection, spans, cell-day labels and exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.functions import repair

LIGHTNING_CODE = 10

# level of an exclusion: the burned cells on the event's days, or the ring around them
LEVEL_POLYGON = 2
LEVEL_BUFFER = 3


def build_events(raw: DataFrame, fields: dict[str, Column], extra: Sequence[Column] = ()) -> DataFrame:
    """The typed event table out of split text fields.

    `fields` names the ten date and time fields (start_day ... end_minute) and the scalars fire_id,
    x, y, area_ha, cause, loc, registered_year, duration_min, point_method.
    """
    parts = ("day", "month", "year", "hour", "minute")
    start, start_fixed = repair.normalize_fields([fields[f"start_{p}"] for p in parts])
    end, end_fixed = repair.normalize_fields([fields[f"end_{p}"] for p in parts])
    started = repair.build_datetime(*(start[p] for p in parts))
    ended = repair.build_datetime(*(end[p] for p in parts))
    return raw.select(
        fields["fire_id"].try_cast("bigint").alias("fire_id"),
        fields["x"].cast("double").alias("x"),
        fields["y"].cast("double").alias("y"),
        started.alias("start_datetime"),
        ended.alias("end_datetime"),
        F.to_date(started).alias("ignition_date"),
        start["hour"].try_cast("bigint").alias("start_hour"),
        fields["area_ha"].try_cast("double").alias("area_ha"),
        fields["cause"].try_cast("bigint").alias("cause"),
        fields["loc"].cast("string").alias("loc"),
        fields["registered_year"].try_cast("bigint").alias("registered_year"),
        fields["duration_min"].try_cast("bigint").alias("duration_min"),
        repair.near_midnight(start["hour"]).alias("near_midnight"),
        repair.suspicious_default_time(start["hour"]).alias("suspicious_default_time"),
        fields["point_method"].alias("ignition_point_method"),
        (start_fixed | end_fixed).alias("date_format_normalized"),
        *extra,
    )


def prepare_events(
    events: DataFrame, cell: Column, start: str = "ignition_date", end: str = "end_date_raw"
) -> DataFrame:
    """Dated events with their cell and their first and last day."""
    first, last = repair.event_span(F.col(start), F.col(end))
    return events.where(F.col(start).isNotNull()).withColumns(
        {"cell_id": cell, "start_date": first, "end_date": last}
    )


def span_summary(prepared: DataFrame, all_events: DataFrame) -> DataFrame:
    """How long the events ran, and how many had no date."""
    days = F.date_diff("end_date", "start_date")
    dated = prepared.agg(
        F.count("*").alias("dated"),
        F.median(days).alias("median_days"),
        F.avg(days).alias("mean_days"),
        F.max(days).alias("max_days"),
    )
    from gridrisk.operators.joins import with_scalars

    return with_scalars(all_events.agg(F.count("*").alias("events")), dated)


def positive_rows(
    events: DataFrame,
    active: DataFrame,
    first: str,
    last: str,
    fire: str = "fire_id",
    area: str = "area_ha",
) -> DataFrame:
    """One row per cell-day with an ignition: the largest event's id, and how many there were."""
    window = events.where(F.col("start_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    kept = window.join(active.select("cell_id"), "cell_id", "left_semi")
    return kept.groupBy("cell_id", F.col("start_date").alias("date")).agg(
        F.max_by(F.col(fire), F.struct(F.col(area), -F.col(fire))).alias("fire_id"),
        F.count("*").alias("n_fires"),
    )


def expand_days(df: DataFrame, start: Column, end: Column, slack: int, level: int) -> DataFrame:
    """One row per day of [start - slack, end + slack]; rows stream out, nothing is collected."""
    days = F.sequence(F.date_sub(start, slack), F.date_add(end, slack), F.expr("interval 1 day"))
    return df.select(
        "fire_id", "cell_id", F.explode(days).alias("date"), F.lit(level).cast("tinyint").alias("level")
    )


def exclusion_pairs(
    events: DataFrame, burned: DataFrame, ring: DataFrame, buffer_days: int = 2
) -> DataFrame:
    """Every cell-day an event takes out of the negatives, per event and level.

    `burned` and `ring` are (fire_id, cell_id): the cells of the polygon and of its buffer.
    """
    spans = events.select("fire_id", "start_date", "end_date")
    start, end = F.col("start_date"), F.col("end_date")
    inner = expand_days(burned.join(spans, "fire_id"), start, end, 0, LEVEL_POLYGON)
    outer = expand_days(ring.join(spans, "fire_id"), start, end, buffer_days, LEVEL_BUFFER)
    return inner.unionByName(outer)


#: Days of a block: those of one mask.
BLOCK_DAYS = 32


def day_masks(pairs: DataFrame, keys: Sequence[str], first: Column) -> DataFrame:
    """(keys, block, mask): the days of each key, counted from `first`, as bits of blocks of 32 days.

    Rows of a span fall together before they are shuffled, so what moves grows with the spans and
    not with their days. The days are the bits, so a day that many rows name is one.
    """
    offset = F.date_diff(F.col("date"), first)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(offset, F.lit(BLOCK_DAYS)))
    block = F.floor(offset / BLOCK_DAYS).cast("int")
    return pairs.groupBy(*keys, block.alias("block")).agg(F.bit_or(bit).alias("mask"))


def days_of(masks: DataFrame) -> DataFrame:
    """A row a day again: `offset`, in days from the masks' first day."""
    days = F.filter(F.sequence(F.lit(0), F.lit(BLOCK_DAYS - 1)), lambda k: F.getbit("mask", k) == 1)
    return masks.select("*", F.explode(days).alias("_k")).withColumn("offset", F.col("block") * BLOCK_DAYS + F.col("_k")).drop("_k", "block", "mask")


def unique_exclusions(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("cell_id", "date").agg(F.min("level").alias("level"))


def near_other_events(positives: DataFrame, pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Flag positives that an event with another ignition cell-day reaches.

    Only whether some other source reaches the cell-day matters. The pairs are first reduced to
    the smallest and largest source per cell-day, so a cell-day many events reach stays one row.
    They meet the positives as bits of blocks of days, never day by day.
    """
    epoch = F.lit("1970-01-01").cast("date")
    masks = day_masks(pairs, ["fire_id", "cell_id"], epoch)
    offset = F.date_diff(F.col("date"), epoch)
    wanted = positives.select(
        "cell_id", "date", F.floor(offset / BLOCK_DAYS).cast("int").alias("block"), F.pmod(offset, F.lit(BLOCK_DAYS)).alias("_bit")
    ).distinct()
    met = masks.join(wanted, ["cell_id", "block"]).where(F.getbit("mask", F.col("_bit")) == 1)
    source = events.select(
        "fire_id",
        F.struct(F.col("cell_id").alias("c"), F.col("start_date").alias("d")).alias("source"),
    )
    reached = (
        met.select("fire_id", "cell_id", "date")
        .join(source, "fire_id")
        .groupBy("cell_id", "date")
        .agg(F.min("source").alias("low"), F.max("source").alias("high"))
    )
    own = F.struct(F.col("cell_id").alias("c"), F.col("date").alias("d"))
    other = F.coalesce((F.col("low") != own) | (F.col("high") != own), F.lit(False))
    return (
        positives.join(reached, ["cell_id", "date"], "left")
        .withColumn("is_near_fire", other)
        .drop("low", "high")
    )


def later_cases(events: DataFrame, last_year: int, lon: Column, lat: Column) -> DataFrame:
    """Events dated after the modelling record, in the shape of the case file."""
    hour = F.col("start_hour")
    return events.where(F.year("ignition_date") > last_year).select(
        F.concat(F.lit("record-"), F.col("fire_id").cast("string")).alias("id"),
        F.col("ignition_date").alias("date"),
        hour.cast("int").alias("hour"),
        lat.alias("lat"),
        lon.alias("lon"),
        F.lit(0.0).alias("uncertainty_m"),
        F.lit("cadastre").alias("coord_source"),
        F.coalesce(
            F.col("loc"), F.concat(F.lit("fire "), F.col("fire_id").cast("string"))
        ).alias("place"),
        F.col("area_ha"),
        F.when(F.col("cause") == LIGHTNING_CODE, F.lit("lightning"))
        .otherwise(F.lit("unknown"))
        .alias("cause"),
    )


def shift_near_midnight(
    samples: DataFrame, events: DataFrame, first: str, last: str, late: int = 22, early: int = 2
) -> DataFrame:
    """Move positives logged beside midnight to the day next to it; the positive wins a collision.

    Only positives with an event meet its hour. The others go round the join: without an event they
    would all have the same key and meet in one task.
    """
    hours = events.select("fire_id", "start_hour")
    hour = F.col("start_hour")
    move = F.when(hour >= late, F.lit(1)).when(hour < early, F.lit(-1)).otherwise(F.lit(0))
    with_hour = F.coalesce(F.col("is_fire") & F.col("fire_id").isNotNull(), F.lit(False))
    # merged, as the planner takes a projection of many events for small and broadcasts it
    met = samples.where(with_hour).join(hours.hint("merge"), "fire_id", "left")
    moved = met.withColumn("date", F.date_add("date", move)).drop("start_hour")
    both = moved.select(*samples.columns).unionByName(
        samples.where(~with_hour).withColumn("date", F.col("date").cast("date"))
    )
    inside = both.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    keep = [c for c in samples.columns if c not in ("cell_id", "date")]
    best = F.max_by(
        F.struct(*keep), F.struct(F.col("is_fire"), -F.col("sample_id"))
    ).alias("kept")
    return (
        inside.groupBy("cell_id", "date")
        .agg(best)
        .select("cell_id", "date", *(F.col(f"kept.{c}").alias(c) for c in keep))
        .select(*samples.columns)
    )
