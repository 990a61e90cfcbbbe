"""Case-control draws from a population that is counted, never built.

The population is cells x days as a flat index: position of the cell among the active ones times
the number of days, plus the day. Draws are hashed indices, so they are the same on every run and
on any number of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.functions.hashing import draw_key
from gridrisk.operators.events import BLOCK_DAYS, day_masks, days_of
from gridrisk.operators.joins import with_scalars
from gridrisk.operators.ordering import row_ids
from gridrisk.operators.ranking import keep_first
from gridrisk.session import cut_lineage


def cell_positions(cells: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Active cells numbered from 0 in the order of their id."""
    return row_ids(cells.select(cell).distinct(), [F.col(cell)], "position")


def pool_size(positions: DataFrame, exclusions: DataFrame, first: str, n_days: int) -> int:
    """Cell-days a negative may come from; one number reaches the driver."""
    blocked = blocked_days(positions, exclusions, first, n_days)
    return positions.count() * n_days - n_blocked(blocked)


def blocked_days(
    positions: DataFrame, exclusions: DataFrame, first: str, n_days: int, cell: str = "cell_id"
) -> DataFrame:
    """(position, block, mask): excluded cell-days as bits; those off the grid or the record have none."""
    start = F.lit(first).cast("date")
    offset = F.date_diff(F.col("date"), start)
    inside = exclusions.where((offset >= 0) & (offset < n_days))
    return day_masks(inside, [cell], start).join(positions, cell).select("position", "block", "mask")


def n_blocked(blocked: DataFrame) -> int:
    return int(blocked.agg(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0))).first()[0])


def flat_exclusions(
    positions: DataFrame, exclusions: DataFrame, first: str, n_days: int, cell: str = "cell_id"
) -> DataFrame:
    """Excluded cell-days as flat indices; those off the grid or the record have none."""
    days = days_of(blocked_days(positions, exclusions, first, n_days, cell))
    return days.select((F.col("position") * n_days + F.col("offset")).alias("flat"))


def _draws(spark, attempts: int, seed: int, total: Column) -> DataFrame:
    drawn = spark.range(attempts).withColumnRenamed("id", "attempt")
    return drawn.withColumn("flat", F.pmod(draw_key(seed, F.col("attempt")), total))


def _accept(drawn: DataFrame, blocked: DataFrame, n: int, n_days: int) -> DataFrame:
    """The first n draws that are new and not excluded, in the order they were drawn.

    Never sorted by index and cut: that would favour the first cells and the first days.
    """
    day = F.pmod(F.col("flat"), F.lit(n_days))
    place = {"position": F.floor(F.col("flat") / n_days), "block": F.floor(day / BLOCK_DAYS).cast("int"), "_bit": (day % BLOCK_DAYS).cast("int")}
    once = keep_first(drawn, ["flat"], F.col("attempt")).withColumns(place)
    met = once.join(blocked, ["position", "block"], "left")
    taken = F.coalesce(F.getbit("mask", F.col("_bit")) == 1, F.lit(False))
    fresh = met.where(~taken).select(*drawn.columns)
    return row_ids(fresh, [F.col("attempt")], "place").where(F.col("place") < n).drop("place")


def attempts_needed(n: int, available: int, total: int) -> int:
    """Enough draws for n distinct accepted ones, with room to spare.

    Drawing with replacement from `total` hits an available index with chance available / total;
    the coupon count of n distinct ones out of `available` follows, plus ten deviations.
    """
    import math

    if n > available:
        raise ValueError(f"asked for {n} rows, only {available} cell-days are available")
    share = n / available
    if share > 0.999:
        hits = available * (math.log(available) + 12)
    else:
        hits = -available * math.log1p(-share)
    hits += 10 * math.sqrt(hits) + 64
    return math.ceil(hits * total / available)


def sample_negatives(
    cells: DataFrame,
    exclusions: DataFrame,
    n: int,
    first: str,
    n_days: int,
    seed: int,
    cell: str = "cell_id",
) -> DataFrame:
    """n cell-days drawn uniformly from the active cells x days less the exclusions.

    Asking for more than there are is refused; falling short draws further.
    """
    positions = cut_lineage(cell_positions(cells, cell), "positions")
    total = positions.count() * n_days
    blocked = cut_lineage(blocked_days(positions, exclusions, first, n_days, cell), "blocked")
    attempts = attempts_needed(n, total - n_blocked(blocked), total)

    def draw(tries: int) -> DataFrame:
        return _draws(cells.sparkSession, tries, seed, F.lit(total))

    return _to_cell_days(_until(draw, blocked, n, attempts, n_days), positions, first, n_days, cell)


def _until(draw, blocked: DataFrame, n: int, attempts: int, n_days: int) -> DataFrame:
    """The first n accepted draws; more are drawn until there are n, earlier ones kept."""
    while True:
        accepted = cut_lineage(_accept(draw(attempts), blocked, n, n_days), "drawn")
        if accepted.count() >= n:
            return accepted
        attempts *= 2


def _to_cell_days(
    accepted: DataFrame, positions: DataFrame, first: str, n_days: int, cell: str
) -> DataFrame:
    place = F.floor(F.col("flat") / n_days)
    day = F.date_add(F.lit(first).cast("date"), (F.col("flat") % n_days).cast("int"))
    return accepted.select(place.alias("position"), day.alias("date"), "attempt").join(
        positions, "position"
    ).select(cell, "date", "attempt")


def matched_negatives(
    positives: DataFrame,
    cells: DataFrame,
    exclusions: DataFrame,
    n: int,
    first: str,
    n_days: int,
    seed: int,
    cell: str = "cell_id",
    oversample: int = 4,
) -> DataFrame:
    """n other days at the cells of the positives, each positive row as likely as any other."""
    positions = cut_lineage(cell_positions(cells, cell), "positions")
    known = positives.join(cells.select(cell), cell, "left_semi").select(cell, "date")
    rows = cut_lineage(row_ids(known, [F.col(cell), F.col("date")], "row"), "rows")
    n_rows = rows.count()
    blocked = cut_lineage(blocked_days(positions, exclusions, first, n_days, cell), "blocked")
    places = rows.select(cell).distinct().join(positions, cell).select("position")
    gone = blocked.join(places, "position", "left_semi")
    available = places.count() * n_days - n_blocked(gone)
    if n > available:
        raise ValueError(f"asked for {n} rows, only {available} cell-days are available")

    def draw(tries: int) -> DataFrame:
        drawn = cells.sparkSession.range(tries).select(
            F.col("id").alias("attempt"),
            F.pmod(draw_key(f"{seed}-row", F.col("id")), F.lit(n_rows)).alias("row"),
            F.pmod(draw_key(f"{seed}-day", F.col("id")), F.lit(n_days)).alias("offset"),
        )
        placed = drawn.join(rows.select("row", cell), "row").join(positions, cell)
        return placed.select(
            "attempt", (F.col("position") * n_days + F.col("offset")).alias("flat")
        )

    accepted = _until(draw, blocked, n, n * oversample + 256, n_days)
    return _to_cell_days(accepted, positions, first, n_days, cell)


def assemble_samples(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Both classes stacked and numbered by day, cell and class."""
    blank = negatives.select(
        "cell_id",
        "date",
        F.lit(False).alias("is_fire"),
        F.lit(False).alias("is_near_fire"),
        F.lit(None).cast("bigint").alias("fire_id"),
        F.lit(0).cast("bigint").alias("n_fires"),
    )
    fires = positives.select(
        "cell_id",
        "date",
        F.lit(True).alias("is_fire"),
        F.col("is_near_fire"),
        F.col("fire_id"),
        F.col("n_fires").cast("bigint").alias("n_fires"),
    )
    stacked = fires.unionByName(blank)
    order = [F.col("date"), F.col("cell_id"), ~F.col("is_fire")]
    numbered = row_ids(stacked, order, "sample_id")
    return numbered.select(
        F.col("sample_id"),
        "cell_id",
        "date",
        "is_fire",
        "is_near_fire",
        "fire_id",
        F.col("n_fires").cast("smallint").alias("n_fires"),
    )


def stratified_sample(
    df: DataFrame, strata: Sequence[str], key: str, n: int | Column, seed: int | str | Column
) -> DataFrame:
    """The n rows of each stratum with the smallest seeded hash."""
    from gridrisk.operators.ordering import running_sums

    order = F.struct(
        draw_key(seed, F.col(key)).alias("h"), F.col(key).alias("k")
    )
    keyed = df.withColumn("_order", order).withColumn("_one", F.lit(1).cast("bigint"))
    placed = running_sums(keyed, strata, "_order", ["_one"])
    wanted = n if isinstance(n, Column) else F.lit(n)
    return placed.where(F.col("cum__one") <= wanted).select(*df.columns)


def matched_sizes(df: DataFrame, group: str, label: str) -> DataFrame:
    """Smallest number of rows of each class over the groups: what every group is cut to."""
    per_group = df.groupBy(group, label).agg(F.count("*").alias("_n"))
    return per_group.groupBy(label).agg(F.min("_n").alias("size"))


def size_matched(df: DataFrame, group: str, label: str, key: str, seed: int) -> DataFrame:
    """Every group cut to the smallest group's class sizes."""
    return stratified_sample(
        with_sizes(df, group, label), [group, label], key, F.col("size"), seed
    ).drop("size")


def with_sizes(df: DataFrame, group: str, label: str) -> DataFrame:
    """The rows with `size`, what their class is cut to; they stay where they are read.

    A shuffle by the label would bring a whole class into one task.
    """
    return df.join(F.broadcast(matched_sizes(df, group, label)), label)


def repeated_draws(
    df: DataFrame, label: str, key: str, ratio: int, draws: int, seed: int
) -> DataFrame:
    """Every positive, and `ratio` negatives per positive, once per draw.

    A negative enters a draw if its hash for that draw falls under the share wanted, so a draw is
    one pass and no draw is ranked; its size is the wanted one up to chance.
    """
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q")
    )
    share = F.least(F.lit(1.0), F.try_divide(F.col("_p") * ratio, F.col("_q")))
    spread = with_scalars(df, counts).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    )
    u = draw_key(seed, F.col("draw"), F.col(key)) / F.lit(float(1 << 60))
    return spread.where((F.col(label) == 1) | (u < share)).drop("_p", "_q")
