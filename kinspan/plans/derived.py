"""A deterministic segment data set derived from the lineitem table, for queries and their SQL.

Samples are 0 to 49, a chromosome is a return flag, a site a day; arithmetic on ids gives haplotypes and genotypes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES, SITES = 50, 2561
CHROMS = ("A", "N", "R")


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, a, ha, b, hb, pid1, pid2: segments as they come, pairs in no order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pid1 = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return lines.select(
        F.col("l_returnflag").alias("chrom"),
        (F.col("l_suppkey") % SAMPLES).cast("int").alias("a"),
        (F.col("l_linenumber") % 2).cast("int").alias("ha"),
        (F.col("l_partkey") % SAMPLES).cast("int").alias("b"),
        (F.col("l_orderkey") % 2).cast("int").alias("hb"),
        pid1.alias("pid1"),
        (pid1 + F.col("l_quantity").cast("int")).alias("pid2"),
    ).where("a <> b")


def cm(pid: str) -> Column:
    return F.col(pid).cast("float") * F.lit(0.07).cast("float")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("a") > F.col("b")
    return ends(spark, sf_dir).select(
        "chrom",
        F.greatest("a", "b").alias("sid1"),
        F.when(first, F.col("ha")).otherwise(F.col("hb")).alias("hid1"),
        F.least("a", "b").alias("sid2"),
        F.when(first, F.col("hb")).otherwise(F.col("ha")).alias("hid2"),
        "pid1",
        "pid2",
        cm("pid1").alias("cm1"),
        cm("pid2").alias("cm2"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in names, haplotypes from 1 and positions."""
    bp = lambda c: (F.col(c) * 1000 + 1).cast("int")
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    return ends(spark, sf_dir).select(
        name("a").alias("sample1"), (F.col("ha") + 1).alias("hap1"), name("b").alias("sample2"), (F.col("hb") + 1).alias("hap2"), "chrom", bp("pid1").alias("start_bp"), bp("pid2").alias("end_bp")
    )


def samples(spark: SparkSession) -> DataFrame:
    return spark.range(SAMPLES).select(F.col("id").cast("int").alias("sid"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"))


def _per_chrom(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chrom", F.explode(F.array(*map(F.lit, CHROMS))))


def sites(spark: SparkSession) -> DataFrame:
    """A site a day."""
    return _per_chrom(spark.range(SITES).select(F.col("id").cast("int").alias("pid"))).select("chrom", "pid", (F.col("pid") * 1000 + 1).alias("bp"), cm("pid").alias("cm"))


def sparse_sites(spark: SparkSession) -> DataFrame:
    """Stretches of a site a day, and of one in thirteen."""
    days = spark.range(SITES).where("id % 400 < 200 or id % 13 = 0").select(F.col("id").cast("int").alias("day"))
    pid = (F.row_number().over(Window.partitionBy("chrom").orderBy("day")) - 1).cast("int")
    return _per_chrom(days).select("chrom", pid.alias("pid"), (F.col("day") * 1000 + 1).alias("bp"), cm("day").alias("cm"))


def map_points(spark: SparkSession) -> DataFrame:
    """60 points; the tenth to twelfth lie on a flat stretch."""
    k = F.when(F.col("id").between(10, 12), 10).otherwise(F.col("id"))
    return _per_chrom(spark.range(1, 61).select((F.col("id") * 40000 + 1).alias("bp"), ((20 * k + k * k % 17) / F.lit(10.0)).alias("cm")))


def genotypes(spark: SparkSession) -> DataFrame:
    every = spark.range(SITES * SAMPLES).select((F.col("id") % SITES).cast("int").alias("pid"), F.floor(F.col("id") / SITES).cast("int").alias("sid"))
    alt = lambda x, k: F.when(x % k == 0, 0).otherwise(1).cast("tinyint")
    return _per_chrom(every).select("chrom", "pid", "sid", alt(F.col("pid") * 7 + F.col("sid") * 13, 3).alias("a0"), alt(F.col("pid") * 5 + F.col("sid") * 11, 4).alias("a1"))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid of some samples: a sub-population."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey < 12").select((F.col("s_suppkey") % SAMPLES).cast("int").alias("sid")).distinct()
