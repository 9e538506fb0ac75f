"""Distance join of two tables of places on a grid of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetlens.constants import EARTH_RADIUS_M
from streetlens.operators.joins import distance_m
from streetlens.operators.windows import top_n_per_group
from streetlens.session import stage_table

#: Businesses of one cell that one share of its points is compared with.
CELL_ROWS = 4096

#: Most steps in which the distance of the nearest grows.
MOST_RINGS = 12


class Grid:
    """Rows of latitude as high as the distance, each cut into columns no point can reach across.

    Two places within the distance stand in the same row or in neighbouring rows. In a row the columns are at
    least as wide as the distance reaches along the parallel nearest to a pole, so they stand in the same or in
    neighbouring columns of that row; the columns are counted around the globe. Rows from which the distance
    reaches a pole are one cell.
    """

    def __init__(self, max_distance: float):
        # the cells of very small distances stay a metre wide, so that their numbers stay small
        self.reach = math.degrees(max(max_distance, 1.0) / EARTH_RADIUS_M) * (1 + 1e-9)

    def row(self, latitude: Column) -> Column:
        return F.floor((latitude + 90) / self.reach).cast("bigint")

    def columns(self, row: Column) -> Column:
        """Number of columns of a row."""
        low = row * self.reach - 90
        steepest = F.greatest(F.abs(low), F.abs(low + self.reach))
        width = F.degrees(F.asin(F.lit(math.sin(math.radians(min(self.reach, 90)))) / F.cos(F.radians(steepest)))) * (1 + 1e-9)
        return F.when(steepest + self.reach >= 90 - 1e-9, 1).otherwise(F.greatest(F.lit(1), F.floor(360 / width))).cast("bigint")

    def column(self, longitude: Column, columns: Column) -> Column:
        turn = F.pmod(longitude + 180, F.lit(360.0)) / 360
        return F.least(F.floor(turn * columns).cast("bigint"), columns - 1)

    def home(self, places: DataFrame, longitude: str, latitude: str) -> DataFrame:
        """Places with the ``cell_row`` and ``cell_column`` they stand in."""
        rows = places.withColumn("cell_row", self.row(F.col(latitude)))
        return rows.withColumn("cell_column", self.column(F.col(longitude), self.columns(F.col("cell_row"))))

    def around(self, places: DataFrame, longitude: str, latitude: str) -> DataFrame:
        """Each place once for every cell that may hold something within the distance: nine at most."""
        own = self.row(F.col(latitude))
        rows = places.withColumn("cell_row", F.explode(F.sequence(own - 1, own + 1)))
        counted = rows.withColumn("cell_columns", self.columns(F.col("cell_row")))
        middle = self.column(F.col(longitude), F.col("cell_columns"))
        near = F.array_distinct(F.transform(F.array(middle - 1, middle, middle + 1), lambda c: F.pmod(c, F.col("cell_columns"))))
        return counted.withColumn("cell_column", F.explode(near)).drop("cell_columns")


def _placed(table: DataFrame, longitude: str, latitude: str) -> DataFrame:
    lon, lat = F.col(longitude).cast("double"), F.col(latitude).cast("double")
    # a comparison with NaN, null or an infinity fails on one side or the other
    return table.filter(lat.between(-90.0, 90.0) & (F.abs(lon) <= 1e6))


def _within(points: DataFrame, businesses: DataFrame, max_distance: float) -> DataFrame:
    """Pairs of (``point`` struct, ``place`` struct) within the distance."""
    grid = Grid(max_distance)
    homes = grid.home(businesses.select("place", "place.longitude", "place.latitude"), "longitude", "latitude").drop("longitude", "latitude")
    cell = ["cell_row", "cell_column"]
    # a cell with very many businesses is shared out; cells without any take no copies of points
    shares = homes.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("shares"))
    sent = grid.around(points.select("point", "point.longitude", "point.latitude"), "longitude", "latitude").drop("longitude", "latitude")
    sent = sent.join(shares, cell).withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1))).drop("shares")
    dealt = homes.join(shares, cell).withColumn("share", F.pmod(F.xxhash64("place"), F.col("shares"))).drop("shares")
    return _measured(sent.join(dealt, [*cell, "share"]), grid, max_distance)


def _measured(pairs: DataFrame, grid: Grid, max_distance: float, *others: str) -> DataFrame:
    here, there = F.col("point"), F.col("place")
    pairs = pairs.filter(F.abs(here["latitude"] - there["latitude"]) <= grid.reach)
    metres = distance_m(there["longitude"].cast("double"), there["latitude"].cast("double"), here["longitude"].cast("double"), here["latitude"].cast("double"))
    return pairs.select(*others, "point", "place", metres.alias("distance_m")).filter(F.col("distance_m") <= max_distance)


def _nearest(points: DataFrame, businesses: DataFrame, max_distance: float, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` pairs within the distance of each point (``point``, ``place``, ``distance_m``).

    Here a point stands in one cell and the businesses are sent around, so a task that holds a cell ranks what it
    compares: pairs are never exchanged, only the first ``k`` of each point are. Cells with very many rows are
    shared out on both sides.
    """
    grid = Grid(max_distance)
    cell, key = ["cell_row", "cell_column"], ["cell_row", "cell_column", "share", "slot"]
    homes = grid.home(points.select("point", "point.longitude", "point.latitude"), "longitude", "latitude").drop("longitude", "latitude")
    sent = grid.around(businesses.select("place", "place.longitude", "place.latitude"), "longitude", "latitude").drop("longitude", "latitude")
    parts = F.ceil(F.count(F.lit(1)) / CELL_ROWS)
    sizes = homes.groupBy(*cell).agg(parts.alias("slots")).join(sent.groupBy(*cell).agg(parts.alias("shares")), cell)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    here = homes.join(sizes, cell).withColumn("slot", F.pmod(F.xxhash64("point"), F.col("slots"))).withColumn("share", each("shares"))
    there = sent.join(sizes, cell).withColumn("share", F.pmod(F.xxhash64("place"), F.col("shares"))).withColumn("slot", each("slots"))
    # both sides are dealt by cell, which is the partitioning that the ranking needs
    pairs = here.select(*key, "point").hint("merge").join(there.select(*key, "place"), key)
    near = _measured(pairs, grid, max_distance, *key)
    return top_n_per_group(top_n_per_group(near, [*key, "point"], order, k, salts=1).drop(*key), ["point"], order, k, salts=1)


def _rings(businesses: DataFrame, max_distance: float, k: int, rings: int) -> int:
    """As many rings as leave ``k`` businesses (four at least), in the mean of all, in a cell of the first; ``rings`` at least."""
    longitude, latitude = F.col("place.longitude"), F.col("place.latitude")

    def cell(level: int) -> Column:
        grid = Grid(max_distance / 2 ** level)
        row = grid.row(latitude)
        return F.struct(F.lit(level).alias("level"), row.alias("cell_row"), grid.column(longitude, grid.columns(row)).alias("cell_column"))

    cells = businesses.select(F.explode(F.array(*[cell(level) for level in range(MOST_RINGS)])).alias("c"))
    counts = cells.groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("n"))
    means = counts.groupBy("c.level").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mean")).collect()
    # every business is in its own cell, so one to a cell says nothing
    return max([rings, *[row.level + 1 for row in means if row["mean"] >= max(k, 4)]])


def near_pairs(
    points: DataFrame, businesses: DataFrame, max_distance: float = 5000, k: int | None = None,
    business_id: str = "source_id", rings: int = 3,
) -> DataFrame:
    """Businesses within ``max_distance`` metres of every point; the ``k`` nearest of each when given.

    Both tables have ``longitude`` and ``latitude``. Result: ``point`` (struct of the point's row), ``place`` (struct
    of the business's row), ``distance_m``. Points without a business near have no row; rows without a
    usable position (null, NaN, a latitude beyond a pole) take no part; equal rows of points count once. Distances that
    agree to a micrometre are ties and go to the smaller business id.

    An equi join on grid cells: a business stands in one cell, a point is sent to the cells its distance reaches.
    Cells with many businesses are shared out over several keys. With ``k`` the distance grows in ``rings`` steps or
    more, as the businesses lie dense, each twice the one before, and businesses are sent to the points: a point that has found ``k`` within a step is done, so dense places are compared on
    a fine grid and only lonely points look further.
    """
    def rows(table: DataFrame, name: str) -> DataFrame:
        return _placed(table, "longitude", "latitude").select(F.struct(*table.columns).alias(name))

    places = rows(businesses, "place")
    waiting = rows(points, "point").distinct()
    if k is None:
        return _within(waiting, places, max_distance)
    order = [F.round("distance_m", 6).asc(), F.col("place")[business_id].asc(), F.xxhash64("place").asc()]
    done, rings = None, _rings(places, max_distance, k, rings)
    for ring in range(rings):
        distance = max_distance / 2 ** (rings - 1 - ring)
        waiting = stage_table(waiting, "near-waiting")
        found = _nearest(waiting, places, distance, order, k)
        if ring < rings - 1:
            found = stage_table(found, "near-found")
            full = found.groupBy("point").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("point")
            same = F.col("point").eqNullSafe(F.col("full"))
            full = full.withColumnRenamed("point", "full")
            waiting = waiting.join(full, same, "left_anti")
            found = found.join(full, same, "left_semi")
        done = found if done is None else done.unionByName(found)
    return done
