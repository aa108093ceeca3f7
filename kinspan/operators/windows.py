"""Counts along the chromosome: site density, coverage, lengths; regions by density and by exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions import scalars as S
from kinspan.operators import genetic_map


#: Chromosomes to which exclusion lines without one are spread.
MOST_CHROMS = 10_000


def _counts(sites: DataFrame, window: float) -> DataFrame:
    """chrom, win and, of the sites in each window, how many there are (n), how many lie at its start or before (early),
    and how many past the start of the next (late): windows by division and starts by the 32-bit product differ a little."""
    if window <= 0:
        raise ValueError("a window needs a width")
    w = F.lit(float(window))
    most = F.max("cm").cast("double")
    planned = F.floor(F.floor(F.ceil(F.ceil(most) / w) * w) / w)
    spine = sites.groupBy("chrom").agg(F.greatest(planned, F.floor(most / w) + 1).cast("int").alias("bins"))
    none = [F.lit(0).alias(c) for c in ("n", "early", "late")]
    spine = spine.select("chrom", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("win"), *none)
    placed = sites.select("chrom", "cm", F.floor(F.col("cm") / w).cast("int").alias("win"))
    early, late = F.col("cm") <= _start(F.col("win"), window), F.col("cm") > _start(F.col("win") + 1, window)
    # Windows join the sites as counts of 0, so that one aggregation does for a join.
    every = placed.select("chrom", "win", F.lit(1).alias("n"), early.cast("int").alias("early"), late.cast("int").alias("late")).unionByName(spine)
    return every.groupBy("chrom", "win").agg(*(F.sum(c).alias(c) for c in ("n", "early", "late")))


def density(sites: DataFrame, window: float = 2.0) -> DataFrame:
    """Sites in each window of `window` cM: chrom, win, cm (where it starts), n_sites; empty windows too."""
    return _counts(sites, window).select("chrom", "win", S.real(F.col("win") * F.lit(float(window))).alias("cm"), F.col("n").alias("n_sites"))


def _start(win: Column, window: float) -> Column:
    """Where a window starts, by the 32-bit product."""
    return S.real(window) * S.real(win)


def _window_of(cm: Column, window: float, upper: bool) -> Column:
    """The last window that starts at or before cm; or with `upper` the first one that starts at or after it."""
    guess = F.floor(cm / S.real(window)).cast("int")
    if upper:
        guess = guess + 1
        return F.when(_start(guess - 2, window) >= cm, guess - 2).when(_start(guess - 1, window) >= cm, guess - 1).when(_start(guess, window) >= cm, guess).otherwise(guess + 1)
    return F.when(_start(guess + 1, window) <= cm, guess + 1).when(_start(guess, window) <= cm, guess).otherwise(guess - 1)


def coverage(segments: DataFrame, sites: DataFrame, window: float = 1.0) -> DataFrame:
    """Segments over each window: chrom, win, cm (where it starts), n_segments.

    A segment covers the windows from the one it starts in up to, not including, the first that starts at or after its
    end. It adds one where it begins and takes one away where it ends; both are summed by window before anything moves,
    then a running sum along each chromosome gives the counts. Segments need cm1 and cm2.
    """
    first, last = _window_of(F.col("cm1"), window, False), _window_of(F.col("cm2"), window, True)
    ranges = segments.select("chrom", first.alias("first"), last.alias("last")).where("last > first")
    steps = ranges.select(
        "chrom",
        F.explode(F.array(F.struct(F.col("first").alias("win"), F.lit(1).alias("step")), F.struct(F.col("last").alias("win"), F.lit(-1).alias("step")))).alias("e"),
    )
    spine = sites.groupBy("chrom").agg((F.floor(F.max("cm").cast("double") / F.lit(float(window))) + 1).cast("int").alias("top"))
    spine = spine.select("chrom", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("win"), F.lit(0).alias("step"), F.lit(True).alias("_asked"))
    # Windows join the events as steps of 0, so that one aggregation does for a join.
    every = steps.select("chrom", "e.win", "e.step", F.lit(False).alias("_asked")).unionByName(spine)
    summed = every.groupBy("chrom", "win").agg(F.sum("step").alias("step"), F.max("_asked").alias("_asked"))
    along = Window.partitionBy("chrom").orderBy("win").rowsBetween(Window.unboundedPreceding, 0)
    counted = summed.withColumn("n_segments", F.sum("step").over(along)).where("_asked")
    return counted.select("chrom", "win", _start(F.col("win"), window).alias("cm"), "n_segments")


def length_histogram(segments: DataFrame) -> DataFrame:
    """Segments by whole cM of length, over all chromosomes: cm, n_segments; empty ones up to the longest. None: none."""
    counted = segments.groupBy(F.floor(S.length()).cast("int").alias("cm")).agg(F.count("*").alias("n"))
    spine = counted.agg(F.max("cm").alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("cm"))
    return spine.join(counted, "cm", "left").select("cm", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_segments"))


def _changes(labels: DataFrame, at: str = "pid_s") -> DataFrame:
    """The rows whose label differs from the one before."""
    before = F.lag("label").over(Window.partitionBy("chrom").orderBy(at))
    return labels.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("label"))).drop("_before")


def density_regions(sites: DataFrame, window: float = 2.0, least: int = 10) -> DataFrame:
    """Regions by density: chrom, pid_s, label (1: windows of at least `least` sites). Each reaches to the next.

    A region starts at the first site past its first window's start; one of label 0 a site earlier.
    """
    along = Window.partitionBy("chrom").orderBy("win")
    before = F.sum(F.col("n") - F.col("late")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    # A site past the next window's start still lies before the one after that.
    late = F.sum("late").over(along.rowsBetween(Window.unboundedPreceding, -2))
    label = (F.col("n") >= least).cast("tinyint")
    counted = _counts(sites, window).withColumns({"label": label, "_n": F.coalesce(before, F.lit(0)) + F.coalesce(late, F.lit(0)) + F.col("early"), "_before": F.lag(label).over(along)})
    changed = counted.where(F.col("_before").isNull() | (F.col("_before") != F.col("label")))
    pid = F.when(F.col("win") == 0, 0).otherwise(F.greatest(F.col("_n") - (F.col("label") == 0).cast("int"), F.lit(0)))
    last = changed.select("chrom", pid.cast("int").alias("pid_s"), "win", "label").groupBy("chrom", "pid_s").agg(F.max_by("label", "win").alias("label"))
    return _changes(last)


def exclude(regions: DataFrame, ranges: DataFrame) -> DataFrame:
    """regions (chrom, pid_s, label) with label 0 from pid_left up to, not including, pid_right of each range.

    A range that ends before it starts, or starts before its chromosome's first region, is an error.
    """
    wrong = lambda text, *columns: F.raise_error(F.format_string(f"not a range within the regions: {text}", *columns))
    checked = ranges.withColumn("pid_left", F.when(F.col("pid_left") <= F.col("pid_right"), F.col("pid_left")).otherwise(wrong("%d to %d", "pid_left", "pid_right")))
    ends = F.array(F.struct(F.col("pid_left").alias("pid_s"), F.lit(1).alias("step")), F.struct(F.col("pid_right").alias("pid_s"), F.lit(-1).alias("step")))
    steps = checked.select("chrom", F.explode(ends).alias("e")).select("chrom", "e.pid_s", F.lit(None).cast("tinyint").alias("label"), "e.step")
    every = regions.select("chrom", "pid_s", F.col("label").cast("tinyint").alias("label"), F.lit(0).alias("step")).unionByName(steps)
    merged = every.groupBy("chrom", "pid_s").agg(F.max("label").alias("label"), F.sum("step").alias("step"))
    along = Window.partitionBy("chrom").orderBy("pid_s").rowsBetween(Window.unboundedPreceding, 0)
    label, over = F.last("label", ignorenulls=True).over(along), F.sum("step").over(along)
    found = merged.withColumns({"_label": label, "_over": over})
    known = F.when(F.col("_label").isNull(), wrong("one starts at %d", "pid_s").cast("tinyint")).when(F.col("_over") > 0, 0).otherwise(F.col("_label"))
    return _changes(found.select("chrom", F.col("pid_s").cast("int").alias("pid_s"), known.cast("tinyint").alias("label")))


def exclusion_ranges(lines: DataFrame, chroms: DataFrame, points: DataFrame, sites: DataFrame) -> DataFrame:
    """Ranges of sites (chrom, pid_left, pid_right) of lines (kind, left, right), for each of `chroms` (chrom).

    kind is CM or BP in any case; anything else is an error. CM bounds go through the map.
    """
    kind = F.upper(F.trim("kind"))
    checked = lines.withColumn("kind", F.when(kind.isin("CM", "BP"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), F.col("kind")))))
    every = checked
    if "chrom" not in lines.columns:  # each line holds for every chromosome; their names come to the driver
        names = [r.chrom for r in chroms.select("chrom").distinct().limit(MOST_CHROMS + 1).collect()]
        if len(names) > MOST_CHROMS:
            raise ValueError(f"over {MOST_CHROMS} chromosomes")
        every = checked.withColumn("chrom", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))
    bp = every.where("kind = 'BP'").select("chrom", F.col("left").alias("left_bp"), F.col("right").alias("right_bp"))
    cm = every.where("kind = 'CM'").select("chrom", F.col("left").alias("cm"), "right")
    cm = genetic_map.to_bp(cm, points).select("chrom", F.col("bp").alias("left_bp"), F.col("right").alias("cm"))
    cm = genetic_map.to_bp(cm, points).select("chrom", F.col("left_bp").cast("double").alias("left_bp"), F.col("bp").cast("double").alias("right_bp"))
    return genetic_map.boundary_pids(bp.unionByName(cm), sites).select("chrom", "pid_left", "pid_right")
