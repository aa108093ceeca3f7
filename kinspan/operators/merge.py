"""Merging neighbouring segments of a pair: gaps and islands with a genotype-aware gap rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions import scalars as S
from kinspan.operators import encode, genotypes

PAIR = ("chrom", "sid1", "sid2")


def merge_with_cm(
    segments: DataFrame, sites: DataFrame, blocks: DataFrame | None = None, most_cm: float = 0.6, most_discordant: int = 1, on_missing: str = "error"
) -> DataFrame:
    """Segments of each pair, merged: chrom, sid1, hid1, sid2, hid2, pid1, pid2, cm1, cm2, haplotypes 0.

    A segment joins the island before it if it starts within it, or if the gap is at most most_cm long and, given
    genotype blocks, has at most most_discordant sites strictly inside at which both samples are homozygous and differ.
    A segment that starts an island lies wholly past every earlier one, so the running maximum of ends over the pair is
    that of the island. It carries its place on the map along, so a segment needs no site but its own ends; by length
    alone windows and the final grouping share one exchange by pair. With genotypes only gaps short enough reach them,
    and what is found too discordant comes back as one list for each pair, by the same key.
    """
    known = encode.placed(segments, sites)
    order = Window.partitionBy(*PAIR).orderBy("pid1", "pid2")
    before = F.max(F.struct("pid2", "cm2")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = known.select(*PAIR, "pid1", "pid2", "cm1", "cm2").withColumn("_before", before)
    gap_start, apart = F.col("_before.pid2"), F.col("_before.pid2") < F.col("pid1")
    short = F.col("cm1") - F.col("_before.cm2") <= S.real(most_cm)
    starts = F.col("_before").isNull() | (apart & ~short)
    if blocks is not None:
        gaps = placed.where(apart & short).select(*PAIR, gap_start.alias("gap_start"), F.col("pid1").alias("gap_end"))
        bad = genotypes.discordance(gaps, blocks, on_missing).where(F.col("n_discordant") > most_discordant)
        bad = bad.groupBy(*PAIR).agg(F.collect_set(F.struct("gap_start", "gap_end")).alias("_bad"))
        placed = placed.join(bad, list(PAIR), "left")
        gap = F.struct(gap_start.alias("gap_start"), F.col("pid1").alias("gap_end"))
        starts = starts | (apart & F.coalesce(F.array_contains("_bad", gap), F.lit(False)))
    # Of equal segments whichever comes first may start an island; peers get the same sum, so all are in it.
    island = F.sum(starts.cast("int")).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        placed.withColumn("_island", island)
        .groupBy(*PAIR, "_island")
        .agg(F.min("pid1").alias("pid1"), F.max("pid2").alias("pid2"), F.min_by("cm1", "pid1").alias("cm1"), F.max_by("cm2", "pid2").alias("cm2"))
        .select("chrom", "sid1", F.lit(0).cast("tinyint").alias("hid1"), "sid2", F.lit(0).cast("tinyint").alias("hid2"), "pid1", "pid2", "cm1", "cm2")
    )


def merge(segments: DataFrame, sites: DataFrame, *args, **rule) -> DataFrame:
    """As `merge_with_cm`, without places on the map."""
    return merge_with_cm(segments, sites, *args, **rule).drop("cm1", "cm2")
