"""Queries that write a source or sink of the derived data set and read it back, and the same in DuckDB SQL.

Each call writes below a new folder of the session's checkpoint folder, or of its warehouse if none is set.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.functions import compare
from kinspan.functions import scalars as S
from kinspan.operators import cut, encode, genetic_map, genotypes, matrix, windows
from kinspan.plans import derived as D
from kinspan.plans import queries as Q
from kinspan.plans import recipes
from kinspan.sources import readers, writers

SHOWN = ["chrom", "sid1", "hid1", "sid2", "hid2", "pid1", "pid2"]


def folder(spark: SparkSession, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, rows: list[str], path: str) -> str:
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    return path


# --- Queries ---------------------------------------------------------------------------------------------------------


def decoded_text(spark, sf_dir):
    """Segments as text of names and positions, read back and encoded again."""
    path = folder(spark, "decoded")
    writers.decoded(encode.decode(D.segments(spark, sf_dir), D.samples(spark), D.sites(spark)), path)
    return encode.encode(readers.raw_segments(spark, path), D.samples(spark), D.sites(spark)).select(
        "chrom", "sid1", F.col("hid1").cast("int").alias("hid1"), "sid2", F.col("hid2").cast("int").alias("hid2"), "pid1", "pid2"
    )


def encoded_table(spark, sf_dir):
    """Encoded segments as a table by chromosome, of which two are read."""
    path = folder(spark, "segments")
    writers.table(D.segments(spark, sf_dir), path)
    return readers.table(spark, path, ["A", "R"]).select(*SHOWN)


def labelled_folders(spark, sf_dir):
    """Cut segments in a folder for each label, of which the kept ones are read."""
    path = folder(spark, "pieces")
    regions = windows.density_regions(D.sparse_sites(spark))
    writers.labelled_segments(cut.split(D.segments(spark, sf_dir), regions, D.sites(spark), Q.LEAST), path)
    return spark.read.parquet(path).where("label = 1").select(*SHOWN)


def site_table(spark, sf_dir):
    """Sites placed on a map that was written and read as text; kept as a table."""
    path = folder(spark, "map")
    points = D.map_points(spark)
    points.select(F.format_string("%s m%d %s %d", "chrom", "bp", F.col("cm").cast("string"), "bp").alias("value")).write.text(f"{path}/text")
    placed = genetic_map.sites(D.sites(spark).select("chrom", "bp"), readers.genetic_map(spark, f"{path}/text"))
    writers.table(placed, f"{path}/sites")
    return readers.table(spark, f"{path}/sites").select("chrom", "pid", "bp", F.round(F.col("cm").cast("double") * 1e4).cast("bigint").alias("cm_e4"))


def sample_list(spark, sf_dir):
    """Samples listed in a text file, by sid; coverage of their segments."""
    path = folder(spark, "names")
    D.chosen(spark, sf_dir).select(F.concat(F.lit("s"), F.col("sid").cast("string"))).write.text(path)
    return readers.sids_of(readers.names(spark, path), D.samples(spark))


def exclusion_lines(spark, sf_dir):
    """Exclusions given as text, in base pairs and in cM, as ranges of sites on every chromosome."""
    path = _lines(spark, ["bp\t100001\t180001", "CM\t10.0\t20.0", "Bp\t700500\t700900"], folder(spark, "exclusions"))
    chroms = D.sites(spark).select("chrom").distinct()
    return windows.exclusion_ranges(readers.exclusions(spark, path), chroms, D.map_points(spark), D.sites(spark))


def variant_text(spark, sf_dir):
    """Genotypes as variant text, a file for a chromosome, read back."""
    path = folder(spark, "variants")
    calls = genotypes_of_one(spark).groupBy("pid").agg(
        F.array_sort(F.collect_list(F.struct("sid", F.concat_ws("|", F.col("a0").cast("string"), F.col("a1").cast("string")).alias("call")))).alias("calls")
    )
    line = F.concat_ws("\t", F.lit("A"), (F.col("pid") * 1000 + 1).cast("string"), F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), F.array_join(F.transform("calls", lambda c: c["call"]), "\t"))
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"s{k}" for k in range(D.SAMPLES))])
    first = spark.createDataFrame([(-1, head)], "pid int, value string")
    first.unionByName(calls.select("pid", line.alias("value"))).orderBy("pid").select("value").write.text(path)
    _, _, found = readers.vcf(spark, path, "A")
    return found.select("pid", "sid", F.col("a0").cast("int").alias("a0"), F.col("a1").cast("int").alias("a1"))


def genotypes_of_one(spark: SparkSession) -> DataFrame:
    return D.genotypes(spark).where("chrom = 'A'")


def matrix_binary(spark, sf_dir):
    """Totals of each chromosome as binary matrices, read back and added."""
    path = folder(spark, "matrix")
    each = matrix.totals(D.segments(spark, sf_dir), Q.LEAST, by_chrom=True)
    for c in D.CHROMS:
        writers.matrix_file(each.where(F.col("chrom") == c), D.SAMPLES, f"{path}/{c}.mat")
    return recipes.matrix_files(spark, [f"{path}/{c}.mat" for c in D.CHROMS], f"{path}/sum")


def matrix_histogram_text(spark, sf_dir):
    """Lines of the histogram of totals in bins of 5 cM."""
    path = folder(spark, "histogram")
    writers.histogram_text(matrix.histogram(Q.total_by_pair(spark, sf_dir), D.SAMPLES, 5.0), path, D.SAMPLES)
    return spark.read.text(path).toDF("line")


def coverage_binary(spark, sf_dir):
    """Coverage of one chromosome in binary form, read back."""
    path = f"{folder(spark, 'coverage')}/A.cov"
    found = windows.coverage(D.segments(spark, sf_dir), D.sites(spark)).where("chrom = 'A'")
    writers.coverage_file(found, path, 1.0)
    return readers.coverage_file(spark, path).select("win", "cm", "n_segments", "window")


def coverage_text(spark, sf_dir):
    """Lines of the coverage report; all records count as processed, also those outside the sub-population."""
    path = folder(spark, "coverage")
    recipes.coverage_report(D.segments(spark, sf_dir), D.sites(spark), path, 1.0, D.chosen(spark, sf_dir))
    return spark.read.text(path).toDF("line")


def density_text(spark, sf_dir):
    path = folder(spark, "density")
    writers.density_text(windows.density(D.sparse_sites(spark)), path, 2.0)
    return spark.read.text(path).toDF("line")


def label_text(spark, sf_dir):
    path = folder(spark, "labels")
    writers.label_text(windows.density_regions(D.sparse_sites(spark)).where("chrom = 'A'"), D.sparse_sites(spark), path)
    columns = F.split("value", "\t")
    return spark.read.text(path).where("value not like 'chrom%'").select(columns[1].cast("int").alias("pid_s"), columns[2].cast("int").alias("bp"), F.round(columns[3].cast("float") * 1000).cast("bigint").alias("cm_milli"), columns[4].cast("int").alias("label"))


def stat_text(spark, sf_dir):
    path = folder(spark, "stat")
    writers.stat_text(recipes.stat(D.segments(spark, sf_dir), D.sites(spark)), path)
    return spark.read.text(path).toDF("line")


def view_pair(spark, sf_dir):
    """One pair's segments by names; haplotypes stay 0 and 1."""
    found = recipes.view_by_name(D.segments(spark, sf_dir), D.samples(spark), D.sites(spark), "s7", "s31")
    return found.select("sample1", "hap1", "sample2", "hap2", "chrom", "start_bp", "end_bp")


def dense_matrix(spark, sf_dir):
    """The dense, symmetric matrix, as rows."""
    full = writers.dense(Q.total_by_pair(spark, sf_dir), D.SAMPLES)
    return spark.createDataFrame([(i, j, round(float(x) * 10)) for i, row in enumerate(full) for j, x in enumerate(row)], "row int, col int, cm10x long")


def sort_by_haplotype(spark, sf_dir):
    """Segments by haplotype pair, with their place in that order."""
    placed = encode.ordered(D.segments(spark, sf_dir).distinct(), "haplotype").select(*SHOWN, F.monotonically_increasing_id().alias("_at"))
    first = placed.groupBy("chrom", "sid1").agg(F.min("_at").alias("_first"))
    # Within a sample rows follow one another, across partitions as well.
    return placed.join(first, ["chrom", "sid1"]).withColumn("_n", F.row_number().over(_along("chrom", "sid1"))).select(*SHOWN, F.col("_n").cast("bigint").alias("nr"))


def _along(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy("_at")


def first_and_last(spark, sf_dir):
    """The first and the last three totals in order."""
    totals = Q.total_by_pair(spark, sf_dir)
    return compare.head(totals, 3).unionByName(compare.tail(totals, 3))


def total_subset_of_haplotypes(spark, sf_dir):
    return matrix.subset(Q.total_by_haplotype_pair(spark, sf_dir), D.chosen(spark, sf_dir), haplotypes=True, d=D.SAMPLES)


def split_tokens(spark, sf_dir):
    """Fields of a delimited line: empty ones inside stay, an empty last one goes."""
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("7"), F.col("o_custkey").cast("string"), F.lit(""))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", S.whole_numbers(line).alias("n")).select(
        "o_orderkey", F.size("n").cast("int").alias("n_fields"), F.col("n")[1].alias("second"), F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")
    )


_CHECKED = "select chrom, sid1, hid1, sid2, hid2, pid1, pid2 from seg"
_HAP_TOTALS = Q._SEG + """, totals as (select cast(sid1 * 2 + hid1 as int) as "row", cast(sid2 * 2 + hid2 as int) as col,
        cast(sum(cast(round((cm2 - cm1) * cast(10 as float)) as bigint)) as bigint) as cm10x
        from seg where cm2 - cm1 >= cast(0.5 as float) group by all)"""
_COVERAGE = Q._SEG + f""", w as (select cast(i as int) as win from range(cast(floor(cast(2560 as float) * cast(0.07 as float)) as bigint) + 2) t(i))"""

_SQL = {
    decoded_text: f"with {Q._SEG} {_CHECKED}",
    encoded_table: f"with {Q._SEG} {_CHECKED} where chrom in ('A', 'R')",
    labelled_folders: f"""with {Q._SPARSE}, {Q._REGIONS}, {Q._SEG}, span as (select *, lead(pid_s) over (partition by chrom order by pid_s) as pid_e from regions),
        piece as (select s.chrom, sid1, hid1, sid2, hid2, cast(greatest(pid1, pid_s) as int) as pid1, cast(least(pid2, coalesce(pid_e, pid2)) as int) as pid2, label
            from seg s join span r on s.chrom = r.chrom and pid_s <= pid2 and (pid_e is null or pid_e > pid1))
        select chrom, sid1, hid1, sid2, hid2, pid1, pid2 from piece where label = 1
        and cast(pid2 as float) * cast(0.07 as float) - cast(pid1 as float) * cast(0.07 as float) >= cast(0.5 as float)""",
    site_table: f"""with {Q._SITES}, {Q._POINTS} select s.chrom, s.pid, s.bp, cast(round(cast(cast((s.bp - p.bp) * slope + p.cm as float) as double) * 1e4) as bigint) as cm_e4
        from sites s asof join points p on s.chrom = p.chrom and s.bp >= p.bp""",
    sample_list: f"with {Q._CHOSEN} select sid from chosen",
    exclusion_lines: f"""with {Q._SITES}, {Q._POINTS}, given_bp as (
            select chrom, l as left_bp, r as right_bp from (values (100001.0, 180001.0), (700500.0, 700900.0)) v(l, r), {Q._CHROMS}
        ), at_cm as (select chrom, cm, k from (values (10.0::double, 'l'), (20.0::double, 'r')) v(cm, k), {Q._CHROMS}
        ), last_point as (select a.chrom, a.cm, k, max(p.bp) as bp from at_cm a join points p on a.chrom = p.chrom and p.cm <= a.cm group by all
        ), as_bp as (select f.chrom, k, round(f.bp + coalesce((f.cm - p.cm) / nullif(slope, 0), 0)) as bp from last_point f join points p on f.chrom = p.chrom and f.bp = p.bp
        ), every as (select * from given_bp union all select chrom, max(bp) filter (k = 'l'), max(bp) filter (k = 'r') from as_bp group by chrom)
        select e.chrom, cast(greatest(count(*) filter (s.bp <= left_bp) - 1, 0) as int) as pid_left, cast(count(*) filter (s.bp <= right_bp) as int) as pid_right
        from every e join sites s using (chrom) group by e.chrom, left_bp, right_bp""",
    variant_text: f"with {Q._GT} select pid, sid, a0, a1 from gt",
    matrix_binary: f"with {Q._TOTALS} select * from totals",
    matrix_histogram_text: f"""with {Q._TOTALS}, h as (select cast(floor(cm10x / 50) as int) as bin, count(*) as n from totals group by all),
        s as (select cast(unnest(range(cast(ceil((select max(cm10x) from totals) / 50.0) as bigint) + 1)) as int) as bin),
        f as (select bin, cast(coalesce(n, 0) + case when bin = 0 then 50 * 49 / 2 - (select count(*) from totals) else 0 end as bigint) as n_pairs from s left join h using (bin))
        select '# pairs: 1225' as line union all select '# pairs of a bin or more: ' || (select cast(sum(n_pairs) as bigint) from f where bin > 0)
        union all select '# samples: 50' union all select concat_ws(chr(9), 'cm', 'n_pairs') union all select concat_ws(chr(9), cast(bin * 5 as varchar) || '.0', n_pairs) from f""",
    coverage_binary: f"""with {_COVERAGE} select win, cast(win as float) as cm, count(seg.chrom) as n_segments, cast(1 as float) as "window" from w left join seg
        on seg.chrom = 'A' and cast(win + 1 as float) > cm1 and cast(win as float) < cm2 group by all""",
    coverage_text: f"""with {_COVERAGE}, {Q._CHOSEN}, kept as (select * from seg where sid1 in (from chosen) and sid2 in (from chosen)),
        c as (select c.chrom, win, count(kept.chrom) as n from w cross join {Q._CHROMS} c left join kept
            on kept.chrom = c.chrom and cast(win + 1 as float) > cm1 and cast(win as float) < cm2 group by all)
        select '# window: 1.0' as line union all select '# records processed: ' || (select count(*) from seg) union all select '# coverage'
        union all select concat_ws(chr(9), 'chrom', 'cm', 'n_segments') union all select concat_ws(chr(9), chrom, cast(win as varchar) || '.0', n) from c""",
    density_text: f"""with {Q._SPARSE}, {Q._DENSITY} select '# window: 2.0' as line union all select '# sites in each window' union all select '# density'
        union all select concat_ws(chr(9), 'chrom', 'cm', 'n_sites') union all select concat_ws(chr(9), chrom, cast(win * 2 as varchar) || '.0', n_sites) from density""",
    label_text: f"""with {Q._SPARSE}, {Q._REGIONS} select cast(pid_s as int) as pid_s, bp, cast(round(cm * cast(1000 as float)) as bigint) as cm_milli, cast(label as int) as label
        from regions r left join sites s on s.chrom = r.chrom and s.pid = r.pid_s where r.chrom = 'A'""",
    stat_text: f"""with {Q._SEG}, h as (select cast(floor(cm2 - cm1) as int) as cm, count(*) as n from seg group by all),
        s as (select cast(unnest(range((select max(cm) from h) + 1)) as int) as cm)
        select '# segments by length' as line union all select concat_ws(chr(9), 'cm', 'n_segments') union all select concat_ws(chr(9), cm, coalesce(n, 0)) from s left join h using (cm)""",
    view_pair: f"""with {Q._SEG} select 's31' as sample1, hid1 as hap1, 's7' as sample2, hid2 as hap2, chrom, pid1 * 1000 + 1 as start_bp, pid2 * 1000 + 1 as end_bp
        from seg where sid1 = 31 and sid2 = 7""",
    dense_matrix: f"""with {Q._TOTALS}, n as (select cast(i as int) as i from range(50) t(i))
        select a.i as "row", b.i as col, coalesce(cm10x, 0) as cm10x from n a cross join n b
        left join totals on "row" = greatest(a.i, b.i) and col = least(a.i, b.i)""",
    sort_by_haplotype: f"""with {Q._SEG}, one as (select distinct chrom, sid1, hid1, sid2, hid2, pid1, pid2 from seg)
        select *, row_number() over (partition by chrom, sid1 order by hid1, sid2, hid2, pid1, pid2) as nr from one""",
    first_and_last: f"""with {Q._TOTALS}, r as (select *, row_number() over (order by "row", col) as n, row_number() over (order by "row" desc, col desc) as m from totals)
        select "row", col, cm10x from r where n <= 3 union all select "row", col, cm10x from r where m <= 3""",
    total_subset_of_haplotypes: f"""with {_HAP_TOTALS}, {Q._CHOSEN}, ids as (select sid, row_number() over (order by sid) - 1 as new from chosen),
        haps as (select sid * 2 + h as old, cast(new * 2 + h as int) as new from ids, range(2) t(h))
        select r.new as "row", c.new as col, cm10x from totals join haps r on r.old = "row" join haps c on c.old = col""",
    split_tokens: """select o_orderkey, 3 as n_fields, case when o_orderkey % 3 = 0 then 0 else 7 end as second,
        cast(o_orderkey + o_custkey + case when o_orderkey % 3 = 0 then 0 else 7 end as bigint) as total from orders""",
}

QUERIES = {f.__name__: f for f in _SQL}
ORACLE_SQL = {f.__name__: sql for f, sql in _SQL.items()}
