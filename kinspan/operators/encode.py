"""Encoding names and positions to ids, and decoding them; pair lookup.

Dimension tables are joined by equality. Whether one is broadcast is left to the optimizer, which knows its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions import scalars as S


def samples(names: DataFrame) -> DataFrame:
    """sid and name for `names` (name, nr): numbered from 0 by first nr; repeated names count once.

    Numbering takes one task, which holds a name and a number for each sample: of some millions at most.
    """
    one = names.groupBy("name").agg(F.min("nr").alias("nr"))
    return one.select((F.row_number().over(Window.orderBy("nr")) - 1).cast("int").alias("sid"), "name")


def _known(column: Column, what: Column, kind: str) -> Column:
    return F.when(column.isNotNull(), column).otherwise(F.raise_error(F.concat(F.lit(f"unknown {kind}: "), what.cast("string"))))


def encode(raw: DataFrame, samples_: DataFrame, sites: DataFrame) -> DataFrame:
    """Raw segments (sample1, hap1, sample2, hap2, chrom, start_bp, end_bp) to ids, with cm1 and cm2.

    The pair is put in order, sid1 >= sid2, and haplotypes with it. An unknown sample or site is an error. cm1 and
    cm2 are stored with each segment, so that lengths need no further join.
    """
    one = samples_.select(F.col("sid").alias("_s1"), F.col("name").alias("sample1"))
    two = samples_.select(F.col("sid").alias("_s2"), F.col("name").alias("sample2"))
    start = sites.select("chrom", F.col("bp").alias("start_bp"), F.col("pid").alias("pid1"), F.col("cm").alias("cm1"))
    end = sites.select("chrom", F.col("bp").alias("end_bp"), F.col("pid").alias("pid2"), F.col("cm").alias("cm2"))
    joined = raw.join(one, "sample1", "left").join(two, "sample2", "left").join(start, ["chrom", "start_bp"], "left").join(end, ["chrom", "end_bp"], "left")
    a, b = _known(F.col("_s1"), F.col("sample1"), "sample"), _known(F.col("_s2"), F.col("sample2"), "sample")
    ha, hb = S.encoded_hap(F.col("hap1")), S.encoded_hap(F.col("hap2"))
    swap = F.col("_s1") < F.col("_s2")
    return joined.select(
        "chrom",
        F.when(swap, b).otherwise(a).alias("sid1"),
        F.when(swap, hb).otherwise(ha).alias("hid1"),
        F.when(swap, a).otherwise(b).alias("sid2"),
        F.when(swap, ha).otherwise(hb).alias("hid2"),
        _known(F.col("pid1"), F.col("start_bp"), "site").alias("pid1"),
        _known(F.col("pid2"), F.col("end_bp"), "site").alias("pid2"),
        "cm1",
        "cm2",
    )


def with_cm(segments: DataFrame, sites: DataFrame) -> DataFrame:
    """Segments with cm1 and cm2 of their sites."""
    one = sites.select("chrom", F.col("pid").alias("pid1"), F.col("cm").alias("cm1"))
    two = sites.select("chrom", F.col("pid").alias("pid2"), F.col("cm").alias("cm2"))
    return segments.drop("cm1", "cm2").join(one, ["chrom", "pid1"]).join(two, ["chrom", "pid2"])


def placed(segments: DataFrame, sites: DataFrame) -> DataFrame:
    """Segments with cm1 and cm2: as they are if they have them."""
    return segments if {"cm1", "cm2"} <= set(segments.columns) else with_cm(segments, sites)


def both_in(segments: DataFrame, sids: DataFrame) -> DataFrame:
    """Segments whose samples are both in `sids` (sid)."""
    one = sids.select(F.col("sid").alias("sid1"))
    two = sids.select(F.col("sid").alias("sid2"))
    return segments.join(one, "sid1", "left_semi").join(two, "sid2", "left_semi")


def decode(segments: DataFrame, samples_: DataFrame, sites: DataFrame, sids: DataFrame | None = None) -> DataFrame:
    """Names, haplotypes from 1, positions and length; of segments whose samples are both in `sids`, if given."""
    chosen = segments if sids is None else both_in(segments, sids)
    one = samples_.select(F.col("sid").alias("sid1"), F.col("name").alias("sample1"))
    two = samples_.select(F.col("sid").alias("sid2"), F.col("name").alias("sample2"))
    start = sites.select("chrom", F.col("pid").alias("pid1"), F.col("bp").alias("start_bp"), F.col("cm").alias("cm1"))
    end = sites.select("chrom", F.col("pid").alias("pid2"), F.col("bp").alias("end_bp"), F.col("cm").alias("cm2"))
    joined = chosen.drop("cm1", "cm2").join(one, "sid1").join(two, "sid2").join(start, ["chrom", "pid1"]).join(end, ["chrom", "pid2"])
    return joined.select(
        "sample1",
        (F.col("hid1") + 1).cast("int").alias("hap1"),
        "sample2",
        (F.col("hid2") + 1).cast("int").alias("hap2"),
        "chrom",
        "start_bp",
        "end_bp",
        S.length().alias("cm"),
    )


def pair(segments: DataFrame, sid_a: int = 1, sid_b: int = 0) -> DataFrame:
    """Segments of one pair, in either order; haplotypes stay 0 and 1. The filter reaches the scan."""
    if sid_a == sid_b:
        raise ValueError("a pair needs two samples")
    return segments.where((F.col("sid1") == max(sid_a, sid_b)) & (F.col("sid2") == min(sid_a, sid_b)))


def pair_by_name(segments: DataFrame, samples_: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """The same by names, looked up first."""
    found = {r.name: r.sid for r in samples_.where(F.col("name").isin(name_a, name_b)).collect()}
    if missing := {name_a, name_b} - set(found):
        raise ValueError(f"unknown sample: {', '.join(sorted(missing))}")
    return pair(segments, found[name_a], found[name_b])


def ordered(segments: DataFrame, by: str = "pair") -> DataFrame:
    """All segments in total order: by pair, or by pair of haplotypes. Duplicates stay."""
    orders = {
        "pair": ("chrom", "sid1", "sid2", "pid1", "pid2", "hid1", "hid2"),
        "haplotype": ("chrom", "sid1", "hid1", "sid2", "hid2", "pid1", "pid2"),
    }
    return segments.orderBy(*orders[by])
