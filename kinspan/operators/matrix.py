"""Totals of shared length by pair, kept sparse: a row for each pair that shares anything, in tenths of a cM."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions import scalars as S


def long_enough(segments: DataFrame, least_cm: float = 2.0, most_cm: float | None = None) -> DataFrame:
    """Segments of least_cm or more, and of less than most_cm; no upper bound if that is none or below least_cm."""
    kept = S.length() >= S.real(least_cm)
    if most_cm is not None and most_cm >= least_cm:
        kept = kept & (S.length() < S.real(most_cm))
    return segments.where(kept)


def totals(segments: DataFrame, least_cm: float = 2.0, most_cm: float | None = None, haplotypes: bool = False, by_chrom: bool = False) -> DataFrame:
    """row, col (row > col), cm10x: lengths rounded to tenths each, then summed, over all chromosomes or by chrom.

    haplotypes: pairs of haplotypes, numbered 2 * sid + hid. Segments need cm1 and cm2.
    """
    row, col = F.col("sid1"), F.col("sid2")
    if haplotypes:
        row, col = row * 2 + F.col("hid1"), col * 2 + F.col("hid2")
    keys = ["chrom"] * by_chrom + ["row", "col"]
    picked = long_enough(segments, least_cm, most_cm).select("chrom", row.cast("int").alias("row"), col.cast("int").alias("col"), S.tenths(S.length()).alias("cm10x"))
    return picked.groupBy(*keys).agg(F.sum("cm10x").alias("cm10x"))


def add(*parts: DataFrame) -> DataFrame:
    """The sum of totals, cell by cell; of one table that has a cell several times, as by chromosome, the same."""
    whole = parts[0].select("row", "col", "cm10x")
    for part in parts[1:]:
        whole = whole.unionByName(part.select("row", "col", "cm10x"))
    return whole.groupBy("row", "col").agg(F.sum("cm10x").alias("cm10x"))


def band(totals_: DataFrame, low_cm: float = 0.0, high_cm: float = 6553.5) -> DataFrame:
    """Cells from low_cm up to, not including, high_cm; bounds are cut to tenths. The default high one is none."""
    if low_cm >= high_cm:
        raise ValueError("the lower bound must be below the upper one")
    low, high = int(low_cm * 10), int(high_cm * 10)
    kept = F.col("cm10x") >= low
    return totals_.where(kept if high >= 65535 else kept & (F.col("cm10x") < high))


def subset(totals_: DataFrame, ids: DataFrame, haplotypes: bool = False, d: int | None = None) -> DataFrame:
    """Cells of the samples in `ids` (sid), numbered anew from 0 by sid.

    Ids are numbered in one task, which holds two numbers for each. Repeated ids are an error, and so are fewer than two and, where the number of samples `d` is given, ids beyond it.
    """
    sid = F.col("sid").cast("int")
    outside = sid.isNull() | (sid < 0) | (sid >= F.lit(d) if d is not None else F.lit(False))
    chosen = ids.select(F.when(outside, F.raise_error(F.concat(F.lit("no such sample: "), F.coalesce(sid.cast("string"), F.lit("null"))))).otherwise(sid).alias("old"))
    if chosen.limit(2).count() < 2:
        raise ValueError("a subset needs two samples at least")
    if haplotypes:
        chosen = chosen.select(F.explode(F.array(F.col("old") * 2, F.col("old") * 2 + 1)).alias("old"))
    n = F.count("*").over(Window.partitionBy("old"))
    checked = chosen.withColumn("old", F.when(n > 1, F.raise_error(F.lit("a repeated id"))).otherwise(F.col("old")))
    numbered = checked.withColumn("new", (F.row_number().over(Window.orderBy("old")) - 1).cast("int"))
    rows = numbered.select(F.col("old").alias("row"), F.col("new").alias("_row"))
    cols = numbered.select(F.col("old").alias("col"), F.col("new").alias("_col"))
    return totals_.join(rows, "row").join(cols, "col").select(F.col("_row").alias("row"), F.col("_col").alias("col"), "cm10x")


def histogram(totals_: DataFrame, d: int, width_cm: float = 1.0) -> DataFrame:
    """Pairs by total: bin, cm (where it starts), n_pairs, over all d * (d - 1) / 2 pairs, those without a cell in bin 0.

    A last bin past the greatest total is kept, empty.
    """
    width = round(width_cm * 10)
    if width < 1:
        raise ValueError("bins of a tenth of a cM at least")
    pairs = d * (d - 1) // 2
    counted = totals_.groupBy(F.floor(F.col("cm10x") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.max("cm10x").alias("top"))
    whole = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.coalesce(F.max("top"), F.lit(0)).alias("top"))
    bins = (F.ceil(F.col("top") / width) + 1).cast("int")
    spine = whole.select("cells", F.explode(F.sequence(F.lit(0), bins - 1)).alias("bin"))
    n = F.coalesce("n", F.lit(0)) + F.when(F.col("bin") == 0, F.lit(pairs) - F.col("cells")).otherwise(0)
    return spine.join(counted, "bin", "left").select("bin", (F.col("bin") * width / 10).alias("cm"), n.cast("bigint").alias("n_pairs"))


def cell(totals_: DataFrame, a: int, b: int) -> DataFrame:
    """The cell of a pair in either order; no row where nothing is shared."""
    return totals_.where((F.col("row") == max(a, b)) & (F.col("col") == min(a, b)))


def from_triangle(cells: DataFrame) -> DataFrame:
    """Sparse totals of a lower triangle (nr, cm10x), numbered row by row from 0."""
    return cells.where("cm10x <> 0").select(
        S.triangle_row(F.col("nr")).cast("int").alias("row"), S.triangle_col(F.col("nr")).cast("int").alias("col"), F.col("cm10x").cast("bigint").alias("cm10x")
    )
