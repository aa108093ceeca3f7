"""Genetic map: slopes, interpolation from bp to cM and back, places of cut points among sites.

Lookups are as-of joins: map points and queries are merged by stretch of the chromosome, and a running last value carries
the point in effect. That needs one sort in place of a range join, whose rows would be tested pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of a chromosome, the last one open, and their length by axis.
STRETCHES, STRETCH = 1024, {"bp": float(1 << 20), "cm": 1.0}


def with_slopes(points: DataFrame) -> DataFrame:
    """Map points (chrom, bp, cm) with slope, the cM for each bp up to the next point.

    A point at bp 0 and 0 cM is put before each chromosome's first, unless it has one; of equal bp the first by cM
    stays. The last slope is that of the point before, and 0 with a single point.
    """
    anchors = points.select("chrom").distinct().select("chrom", F.lit(0).cast("bigint").alias("bp"), F.lit(0.0).alias("cm"))
    own = points.select("chrom", F.col("bp").cast("bigint").alias("bp"), F.col("cm").cast("double").alias("cm"))
    one = anchors.unionByName(own).groupBy("chrom", "bp").agg(F.min("cm").alias("cm"))
    order = Window.partitionBy("chrom").orderBy("bp")
    next_bp, next_cm = F.lead("bp").over(order), F.lead("cm").over(order)
    slope = F.try_divide(next_cm - F.col("cm"), next_bp - F.col("bp"))
    return one.withColumn("slope", slope).withColumn(
        "slope", F.coalesce("slope", F.lag("slope").over(order), F.lit(0.0))
    )


def _as_of(queries: DataFrame, points: DataFrame, on: str, carried: tuple[str, ...]) -> DataFrame:
    """queries with `_point`, the carried columns of the last point at or before them (null: none), by chrom and `on`.

    Both are dealt out by stretch of the chromosome; each stretch also gets the last point before it. Of points at the
    same place the last by the first carried column counts.
    """
    at = F.col(on).cast("double")
    stretch = F.greatest(F.least(F.floor(at / STRETCH[on]), F.lit(STRETCHES - 1)), F.lit(0)).cast("int")
    taken = F.struct(*(F.col(c).alias(c) for c in carried))
    known = points.select("chrom", stretch.alias("_in"), at.alias("_at"), taken.alias("_point"))
    last = known.groupBy("chrom", "_in").agg(F.max(F.struct("_at", "_point")).alias("_last"))
    ahead = F.lead("_in", 1, STRETCHES - 1).over(Window.partitionBy("chrom").orderBy("_in"))
    carry = last.withColumn("_to", ahead).where("_to > _in").select("chrom", F.explode(F.sequence(F.col("_in") + 1, "_to")).alias("_in"), "_last._at", "_last._point")
    asked = queries.select("chrom", stretch.alias("_in"), at.alias("_at"), F.struct("*").alias("_query"))
    # Points come before queries of the same place.
    order = Window.partitionBy("chrom", "_in").orderBy("_at", F.col("_query").isNotNull(), f"_point.{carried[0]}").rowsBetween(Window.unboundedPreceding, 0)
    merged = known.unionByName(carry).withColumn("_query", F.lit(None).cast(asked.schema["_query"].dataType)).unionByName(
        asked.withColumn("_point", F.lit(None).cast(known.schema["_point"].dataType))
    )
    found = merged.withColumn("_point", F.last("_point", ignorenulls=True).over(order)).where("_query is not null")
    return found.select("_query.*", "_point")


def to_cm(queries: DataFrame, points: DataFrame) -> DataFrame:
    """queries (chrom, bp, ...) with cm, interpolated; beyond the last point its slope goes on."""
    found = _as_of(queries, with_slopes(points), "bp", ("bp", "cm", "slope"))
    cm = (F.col("bp") - F.col("_point.bp")) * F.col("_point.slope") + F.col("_point.cm")
    return found.withColumn("cm", cm).drop("_point")


def to_bp(queries: DataFrame, points: DataFrame) -> DataFrame:
    """queries (chrom, cm, ...) with bp, rounded half away from zero; where the map is flat, its last point counts."""
    found = _as_of(queries, with_slopes(points), "cm", ("bp", "cm", "slope"))
    more = F.coalesce(F.try_divide(F.col("cm") - F.col("_point.cm"), F.col("_point.slope")), F.lit(0.0))
    return found.withColumn("bp", F.round(F.col("_point.bp") + more).cast("bigint")).drop("_point")


def flat(queries: DataFrame, points: DataFrame) -> DataFrame:
    """queries (chrom, bp, ...) with is_flat: whether the map doesn't rise there."""
    found = _as_of(queries, with_slopes(points), "bp", ("bp", "cm", "slope"))
    return found.withColumn("is_flat", F.col("_point.slope") == 0).drop("_point")


def sites(positions: DataFrame, points: DataFrame) -> DataFrame:
    """Variant sites (chrom, pid, bp, cm) of positions (chrom, bp): each bp once, numbered from 0, cm as a 32-bit float."""
    one = positions.select("chrom", F.col("bp").cast("int").alias("bp")).distinct()
    placed = to_cm(one, points).withColumn("cm", F.col("cm").cast("float"))
    number = F.row_number().over(Window.partitionBy("chrom").orderBy("bp")) - 1
    return placed.select("chrom", number.cast("int").alias("pid"), "bp", "cm")


def sites_up_to(queries: DataFrame, sites_: DataFrame, on: str = "bp") -> DataFrame:
    """queries (chrom, `on`, ...) with n_sites: how many sites are at or before them; that is the next site's pid."""
    found = _as_of(queries, sites_, on, ("pid",))
    return found.withColumn("n_sites", F.coalesce(F.col("_point.pid") + 1, F.lit(0)).cast("int")).drop("_point")


def boundary_pids(ranges: DataFrame, sites_: DataFrame) -> DataFrame:
    """ranges (chrom, left_bp, right_bp) with pid_left (the site at or before, 0 at least) and pid_right (the one after).

    A right bound past the last site gives the number of sites, which stands for an open end.
    """
    left = sites_up_to(ranges.select("chrom", F.col("left_bp").alias("bp"), "right_bp"), sites_)
    left = left.select("chrom", F.col("bp").alias("left_bp"), F.col("right_bp").alias("bp"), F.greatest(F.col("n_sites") - 1, F.lit(0)).alias("pid_left"))
    both = sites_up_to(left, sites_)
    return both.select("chrom", "left_bp", F.col("bp").alias("right_bp"), "pid_left", F.col("n_sites").alias("pid_right"))


def is_between(column: Column, low, high) -> Column:
    return (column >= low) & (column < high)
