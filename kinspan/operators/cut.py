"""Cutting segments by regions: a range join made an equality join on buckets of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions import scalars as S
from kinspan.operators import encode

#: Regions up to this number become a local table, whose size the optimizer knows; beyond it they stay where they are.
LOCAL_REGIONS = 20_000


def region_ends(regions: DataFrame) -> DataFrame:
    """regions (chrom, pid_s, label) with pid_e, the next one's start; null for a chromosome's last."""
    return regions.withColumn("pid_e", F.lead("pid_s").over(Window.partitionBy("chrom").orderBy("pid_s")))


def _spans(regions: DataFrame, sites: DataFrame) -> DataFrame:
    """chrom, pid_s, cm_s, pid_e, cm_e, label, last: regions with the places of their ends and the last site in them."""
    ends = sites.groupBy("chrom").agg(F.max("pid").alias("top"))
    placed = regions.join(sites.select("chrom", F.col("pid").alias("pid_s"), F.col("cm").alias("cm_s")), ["chrom", "pid_s"], "left").join(ends, "chrom")
    along = Window.partitionBy("chrom").orderBy("pid_s")
    spans = placed.withColumns({"pid_e": F.lead("pid_s").over(along), "cm_e": F.lead("cm_s").over(along)})
    last = F.coalesce(F.col("pid_e") - 1, F.greatest("pid_s", "top"))
    spans = spans.select("chrom", "pid_s", "cm_s", "pid_e", "cm_e", "label", last.alias("last"))
    few = spans.limit(LOCAL_REGIONS + 1).toArrow()
    return spans.sparkSession.createDataFrame(few, spans.schema) if len(few) <= LOCAL_REGIONS else spans


def split(segments: DataFrame, regions: DataFrame, sites: DataFrame, least_cm: float = 2.0, bucket: int = 1024) -> DataFrame:
    """Segments cut where regions change: a piece for each region they touch, with its label.

    A piece ends on the next region's first site, which the next piece shares. Pieces shorter than least_cm go. Both
    sides are spread over buckets of `bucket` sites and joined by equality; a pair that meets in several buckets
    counts in the first it shares. A piece's ends are the segment's or the region's, so no site is looked up for it.
    What lies before a chromosome's first region is in no piece. A segment with pid1 > pid2 is an error.
    """
    div = lambda c: F.floor(F.col(c) / bucket).cast("int")
    spans = _spans(regions, sites).withColumn("_bucket", F.explode(F.sequence(div("pid_s"), div("last"))))
    known = encode.placed(segments, sites)
    backward = F.raise_error(F.format_string("a segment from site %d back to %d", "pid1", "pid2"))
    reach = F.when(F.col("pid1") <= F.col("pid2"), F.sequence(div("pid1"), div("pid2"))).otherwise(backward)
    spread = known.withColumn("_bucket", F.explode(reach))
    meet = (
        (F.col("pid_s") <= F.col("pid2"))
        & (F.col("pid_e").isNull() | (F.col("pid_e") > F.col("pid1")))
        & (F.col("_bucket") == F.greatest(div("pid1"), div("pid_s")))
    )
    begins, ends = F.col("pid_s") > F.col("pid1"), F.col("pid_e") < F.col("pid2")
    cut = spread.join(spans, ["chrom", "_bucket"]).where(meet).select(
        "chrom",
        "sid1",
        "hid1",
        "sid2",
        "hid2",
        F.greatest("pid1", "pid_s").alias("pid1"),
        F.least("pid2", F.coalesce("pid_e", "pid2")).alias("pid2"),
        F.when(begins, F.col("cm_s")).otherwise(F.col("cm1")).alias("cm1"),
        F.when(ends, F.col("cm_e")).otherwise(F.col("cm2")).alias("cm2"),
        "label",
    )
    return cut.where(S.length() >= S.real(least_cm))
