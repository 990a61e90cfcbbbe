"""The cell lattice: ids, centres, points, sub-points, weights from a coarser lattice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid, row-major from the north-west; a cell owns its west and north edges."""

    xmin: float
    ymax: float
    n_cols: int
    n_rows: int
    resolution: float

    @property
    def n_cells(self) -> int:
        return self.n_cols * self.n_rows

    def index(self, cell: Column) -> tuple[Column, Column]:
        return cell % self.n_cols, F.floor(cell / self.n_cols)

    def center(self, cell: Column) -> tuple[Column, Column]:
        col, row = self.index(cell)
        return self.center_at(col, row)

    def center_at(self, col: Column, row: Column) -> tuple[Column, Column]:
        size = F.lit(float(self.resolution))
        return (
            F.lit(float(self.xmin)) + (col + F.lit(0.5)) * size,
            F.lit(float(self.ymax)) - (row + F.lit(0.5)) * size,
        )

    def column_of(self, x: Column) -> Column:
        return F.floor((x - F.lit(float(self.xmin))) / F.lit(float(self.resolution)))

    def row_of(self, y: Column) -> Column:
        return F.floor((F.lit(float(self.ymax)) - y) / F.lit(float(self.resolution)))

    def cell_of(self, x: Column, y: Column) -> Column:
        """Cell of a point, -1 outside."""
        col, row = self.column_of(x), self.row_of(y)
        inside = (col >= 0) & (col < self.n_cols) & (row >= 0) & (row < self.n_rows)
        return F.when(inside, row * self.n_cols + col).otherwise(F.lit(-1).cast("bigint"))

    def box(self, col: Column, row: Column) -> tuple[Column, Column, Column, Column]:
        """x0, y0, x1, y1 of a cell."""
        size = F.lit(float(self.resolution))
        left = F.lit(float(self.xmin)) + col * size
        top = F.lit(float(self.ymax)) - row * size
        return left, top - size, left + size, top


def snap_extent(df: DataFrame, x: str, y: str, resolution: float) -> DataFrame:
    """The smallest grid on the resolution's multiples that holds every point, one row."""
    ends = df.agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
    )
    size = F.lit(float(resolution))
    left, right = F.floor(F.col("x0") / size) * size, F.ceil(F.col("x1") / size) * size
    bottom, top = F.floor(F.col("y0") / size) * size, F.ceil(F.col("y1") / size) * size
    return ends.select(
        left.alias("xmin"),
        top.alias("ymax"),
        F.round((right - left) / size).cast("int").alias("n_cols"),
        F.round((top - bottom) / size).cast("int").alias("n_rows"),
    )


def grid_frame(
    spark: SparkSession,
    spec: GridSpec,
    active: DataFrame,
    non_burnable: DataFrame,
    threshold: float,
) -> DataFrame:
    """One row per cell with its centre, whether it is active and how much of it cannot burn.

    `active` holds the active cell ids, `non_burnable` (cell_id, non_burnable_fraction).
    """
    cell = F.col("cell_id")
    col, row = spec.index(cell)
    x, y = spec.center(cell)
    base = spark.range(spec.n_cells).withColumnRenamed("id", "cell_id")
    marked = active.select("cell_id").distinct().withColumn("is_active", F.lit(True))
    fraction = F.col("non_burnable_fraction")
    return (
        base.join(marked, "cell_id", "left")
        .join(non_burnable, "cell_id", "left")
        .select(
            cell.cast("int").alias("cell_id"),
            col.cast("smallint").alias("x_index"),
            row.cast("int").alias("y_index"),
            x.alias("x"),
            y.alias("y"),
            F.coalesce("is_active", F.lit(False)).alias("is_active"),
            fraction.cast("float").alias("non_burnable_fraction"),
            (F.coalesce(fraction, F.lit(0.0)) >= threshold).alias("is_non_burnable"),
        )
    )


def sub_points(cells: DataFrame, spec: GridSpec, cell: str, per_side: int) -> DataFrame:
    """Evenly spaced points strictly inside each cell, `per_side` squared of them."""
    if per_side < 1:
        raise ValueError(f"per_side must be positive, got {per_side}")
    col, row = spec.index(F.col(cell))
    x0, _, _, y1 = spec.box(col, row)
    steps = F.sequence(F.lit(0), F.lit(per_side - 1))
    spread = cells.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))

    def offset(step: str) -> Column:
        return (F.col(step) + F.lit(0.5)) / F.lit(float(per_side)) * F.lit(float(spec.resolution))

    return spread.withColumns(
        {
            "sub": F.col("_i") * per_side + F.col("_j"),
            "sx": x0 + offset("_j"),
            "sy": y1 - offset("_i"),
        }
    ).drop("_i", "_j")


@dataclass(frozen=True)
class Lattice:
    """The coarse backbone: longitudes rising, latitudes falling, ids row-major."""

    lon0: float
    lat0: float
    step: float
    n_cols: int
    n_rows: int


def bilinear_weights(points: DataFrame, lattice: Lattice, cell: str, lon: str, lat: str) -> DataFrame:
    """The four lattice nodes around each point with their weights, zero weights dropped.

    Points outside are held at the edge, which leaves the nearest node alone.
    """
    if lattice.n_cols < 2 or lattice.n_rows < 2:
        raise ValueError("bilinear weights need a lattice of at least two by two")
    step = F.lit(float(lattice.step))
    col = (F.col(lon) - F.lit(lattice.lon0)) / step
    row = (F.lit(lattice.lat0) - F.col(lat)) / step
    left = F.least(F.greatest(F.floor(col), F.lit(0)), F.lit(lattice.n_cols - 2))
    top = F.least(F.greatest(F.floor(row), F.lit(0)), F.lit(lattice.n_rows - 2))
    fx = F.least(F.greatest(col - left, F.lit(0.0)), F.lit(1.0))
    fy = F.least(F.greatest(row - top, F.lit(0.0)), F.lit(1.0))
    corner = top * lattice.n_cols + left
    one = F.lit(1.0)
    nodes = F.array(
        F.struct(corner.alias("era5_id"), ((one - fx) * (one - fy)).alias("weight")),
        F.struct((corner + 1).alias("era5_id"), (fx * (one - fy)).alias("weight")),
        F.struct((corner + lattice.n_cols).alias("era5_id"), ((one - fx) * fy).alias("weight")),
        F.struct((corner + lattice.n_cols + 1).alias("era5_id"), (fx * fy).alias("weight")),
    )
    return (
        points.select(cell, F.explode(nodes).alias("n"))
        .select(cell, "n.era5_id", "n.weight")
        .where(F.col("weight") > 0)
    )


def nearest_node(value: Column, start: float, step: float, tolerance: float = 1e-6) -> Column:
    """Index of the lattice line a coordinate lies on; off the lines the job fails."""
    place = (value - F.lit(float(start))) / F.lit(float(step))
    index = F.round(place, 0).cast("int")
    off = F.abs(place - index) * abs(step) > tolerance
    return F.when(
        off, F.raise_error(F.lit("a coordinate lies off the lattice")).cast("int")
    ).otherwise(index)
