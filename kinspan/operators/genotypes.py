"""Genotypes as 64-site bitmaps, so that discordant homozygotes are counted a block at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspan.schema import MISSING

BITS = 64


def blocks(genotypes: DataFrame) -> DataFrame:
    """Genotypes (chrom, pid, sid, a0, a1) as chrom, sid, blk, hom_ref, hom_alt, missing: a bit for each site."""
    bit = F.expr(f"shiftleft(1L, cast(pid % {BITS} as int))")

    def bits(condition):
        return F.bit_or(F.when(condition, bit).otherwise(F.lit(0).cast("bigint")))

    a0, a1 = F.col("a0"), F.col("a1")
    return genotypes.groupBy("chrom", "sid", F.floor(F.col("pid") / BITS).cast("int").alias("blk")).agg(
        bits((a0 == 0) & (a1 == 0)).alias("hom_ref"),
        bits((a0 == 1) & (a1 == 1)).alias("hom_alt"),
        bits((a0 == MISSING) | (a1 == MISSING)).alias("missing"),
    )


def discordance(gaps: DataFrame, blocks_: DataFrame, on_missing: str = "error") -> DataFrame:
    """gaps (chrom, sid1, sid2, gap_start, gap_end, ...) with n_discordant: sites strictly inside at which both samples
    are homozygous and differ.

    on_missing: "error" if a site inside has a missing allele in either sample, or "ignore" it.
    """
    if on_missing not in ("error", "ignore"):
        raise ValueError(f"on_missing: {on_missing}")
    names = gaps.columns
    keyed = gaps.select("chrom", "sid1", "sid2", "gap_start", "gap_end").distinct()
    first, last = F.col("gap_start") + 1, F.col("gap_end") - 1
    open_ = keyed.where(last >= first).withColumn(
        "blk", F.explode(F.sequence(F.floor(first / BITS).cast("int"), F.floor(last / BITS).cast("int")))
    )
    low = F.greatest(F.col("gap_start") + 1 - F.col("blk") * BITS, F.lit(0)).cast("int")
    high = F.least(F.col("gap_end") - 1 - F.col("blk") * BITS, F.lit(BITS - 1)).cast("int")
    masked = open_.withColumns({"_low": low, "_high": high}).withColumn(
        "_mask", F.expr("shiftleft(-1L, _low) & shiftrightunsigned(-1L, 63 - _high)")
    )

    def side(n: int) -> DataFrame:
        return blocks_.select(
            "chrom", F.col("sid").alias(f"sid{n}"), "blk", F.col("hom_ref").alias(f"_ref{n}"), F.col("hom_alt").alias(f"_alt{n}"), F.col("missing").alias(f"_miss{n}")
        )

    both = masked.join(side(1), ["chrom", "sid1", "blk"]).join(side(2), ["chrom", "sid2", "blk"])
    differ = F.expr("bit_count(((_ref1 & _alt2) | (_alt1 & _ref2)) & _mask)")
    absent = F.expr("bit_count((_miss1 | _miss2) & _mask)")
    keys = ["chrom", "sid1", "sid2", "gap_start", "gap_end"]
    summed = both.groupBy(*keys).agg(F.sum(differ).cast("int").alias("_n"), F.sum(absent).alias("_absent"))
    if on_missing == "error":
        summed = summed.withColumn("_n", F.when(F.col("_absent") > 0, F.raise_error(F.lit("a missing allele inside a gap"))).otherwise(F.col("_n")))
    found = gaps.join(summed.drop("_absent"), keys, "left")
    return found.select(*names, F.coalesce("_n", F.lit(0)).alias("n_discordant"))


def haplotypes(genotypes: DataFrame) -> DataFrame:
    """chrom, pid, haplotypes: for each site the alleles of all samples by sid, two digits each."""
    digits = F.concat(F.col("a0").cast("string"), F.col("a1").cast("string"))
    return genotypes.groupBy("chrom", "pid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sid", digits.alias("d")))), lambda x: x["d"]), "").alias("haplotypes")
    )


def long_form(sites_text: DataFrame) -> DataFrame:
    """Genotypes of rows (chrom, bp, calls), calls being one string like 0|1 for each sample in order of sid.

    Of rows with equal bp the first by nr stays; a dot is a missing allele; other than two alleles is an error.
    """
    first = Window.partitionBy("chrom", "bp").orderBy("nr")
    one = sites_text.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    number = (F.row_number().over(Window.partitionBy("chrom").orderBy("bp")) - 1).cast("int")
    placed = one.withColumn("pid", number).select("chrom", "pid", "bp", F.posexplode("calls").alias("sid", "call"))
    alleles = F.split(F.split("call", ":")[0], "[|/]")
    code = lambda k: F.when(alleles[k] == ".", MISSING).otherwise(alleles[k].cast("int")).cast("tinyint")
    whole = F.when(F.size(alleles) == 2, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not diploid: "), F.col("call"))))
    return placed.where(whole).select("chrom", "pid", "sid", code(0).alias("a0"), code(1).alias("a1"))
