"""One query for each operator over the derived data set, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.functions import compare
from kinspan.functions import scalars as S
from kinspan.operators import cut, encode, genetic_map, genotypes, matrix, merge, windows
from kinspan.plans import derived as D

LEAST = 0.5

# --- SQL parts -------------------------------------------------------------------------------------------------------

_ENDS = """
    ends as (
        select l_returnflag as chrom, cast(l_suppkey % 50 as int) as a, cast(l_linenumber % 2 as int) as ha,
               cast(l_partkey % 50 as int) as b, cast(l_orderkey % 2 as int) as hb,
               cast(date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as int) as pid1,
               cast(date_diff('day', date '1995-01-01', cast(l_shipdate as date)) + cast(l_quantity as int) as int) as pid2
        from lineitem where cast(l_suppkey % 50 as int) <> cast(l_partkey % 50 as int)
    )"""
_SEG = _ENDS + """, seg as (
        select chrom, greatest(a, b) as sid1, case when a > b then ha else hb end as hid1, least(a, b) as sid2,
               case when a > b then hb else ha end as hid2, pid1, pid2,
               cast(pid1 as float) * cast(0.07 as float) as cm1, cast(pid2 as float) * cast(0.07 as float) as cm2
        from ends
    )"""
_CHROMS = "(select unnest(['A', 'N', 'R']) as chrom)"
_SITES = f"""
    sites as (
        select chrom, cast(d as int) as pid, cast(d * 1000 + 1 as int) as bp, cast(d as float) * cast(0.07 as float) as cm
        from range(2561) t(d), {_CHROMS}
    )"""
_SPARSE = f"""
    sites as (
        select chrom, cast(row_number() over (partition by chrom order by d) - 1 as int) as pid,
               cast(d * 1000 + 1 as int) as bp, cast(d as float) * cast(0.07 as float) as cm
        from range(2561) t(d), {_CHROMS} where d % 400 < 200 or d % 13 = 0
    )"""
_POINTS = f"""
    given as (
        select chrom, i * 40000 + 1 as bp, (20 * k + k * k % 17) / 10.0::double as cm
        from (select i, case when i between 10 and 12 then 10 else i end as k from range(1, 61) t(i)), {_CHROMS}
    ), known as (
        select chrom, bp, cm from given union all select chrom, 0, 0 from {_CHROMS}
    ), steps as (
        select chrom, bp, cm, (lead(cm) over w - cm) / (lead(bp) over w - bp) as own from known
        window w as (partition by chrom order by bp)
    ), points as (
        select chrom, bp, cm, coalesce(own, lag(own) over (partition by chrom order by bp)) as slope from steps
    )"""
_TOTALS = _SEG + """, totals as (
        select sid1 as "row", sid2 as col, cast(sum(cast(round((cm2 - cm1) * cast(10 as float)) as bigint)) as bigint) as cm10x
        from seg where cm2 - cm1 >= cast(0.5 as float) group by all
    )"""
_CHOSEN = "chosen as (select distinct cast(s_suppkey % 50 as int) as sid from supplier where s_nationkey < 12)"
_DENSITY = """
    counted as (select chrom, cast(floor(cm::double / 2.0) as int) as win, count(*) as n from sites group by all),
    spine as (
        select chrom, cast(unnest(range(cast(greatest(floor(floor(ceil(ceil(max(cm)::double) / 2.0) * 2.0) / 2.0),
               floor(max(cm)::double / 2.0) + 1) as bigint))) as int) as win
        from sites group by chrom
    ), density as (
        select chrom, win, coalesce(n, 0) as n_sites from spine left join counted using (chrom, win)
    )"""
_REGIONS = _DENSITY + """, labelled as (
        select chrom, win, case when n_sites >= 10 then 1 else 0 end as label from density
    ), changed as (
        select * from labelled qualify label is distinct from lag(label) over (partition by chrom order by win)
    ), placed as (
        select c.chrom, win, label, case when win = 0 then 0 else greatest(
            (select count(*) from sites s where s.chrom = c.chrom and s.cm <= cast(2.0 as float) * cast(win as float))
            - (1 - label), 0) end as pid_s
        from changed c
    ), one as (select chrom, pid_s, arg_max(label, win) as label from placed group by all),
    regions as (select * from one qualify label is distinct from lag(label) over (partition by chrom order by pid_s))"""
_RANGES = "ranges as (select chrom, l as pid_left, r as pid_right from (values (100, 180), (150, 300), (700, 700), (1200, 1900)) v(l, r), " + _CHROMS + ")"


def _ranges(spark: SparkSession) -> DataFrame:
    given = spark.createDataFrame([(100, 180), (150, 300), (700, 700), (1200, 1900)], "pid_left int, pid_right int")
    return given.select(F.explode(F.array(*map(F.lit, D.CHROMS))).alias("chrom"), "pid_left", "pid_right")


def _milli(column: str):
    return F.round(F.col(column) * 1000).cast("bigint").alias(f"{column}_milli")


# --- Queries ---------------------------------------------------------------------------------------------------------


def total_by_pair(spark, sf_dir):
    return matrix.totals(D.segments(spark, sf_dir), LEAST)


def total_by_haplotype_pair(spark, sf_dir):
    return matrix.totals(D.segments(spark, sf_dir), LEAST, haplotypes=True)


def total_bounded(spark, sf_dir):
    return matrix.totals(D.segments(spark, sf_dir), 0.5, 2.0)


def length_histogram(spark, sf_dir):
    return windows.length_histogram(D.segments(spark, sf_dir))


def site_density(spark, sf_dir):
    return windows.density(D.sparse_sites(spark)).select("chrom", "win", "n_sites")


def coverage(spark, sf_dir):
    return windows.coverage(D.segments(spark, sf_dir), D.sites(spark)).select("chrom", "win", "n_segments")


def coverage_fine(spark, sf_dir):
    return windows.coverage(D.segments(spark, sf_dir), D.sites(spark), 0.1).select("chrom", "win", "n_segments")


def coverage_of_subpopulation(spark, sf_dir):
    kept = encode.both_in(D.segments(spark, sf_dir), D.chosen(spark, sf_dir))
    return windows.coverage(kept, D.sites(spark)).select("chrom", "win", "n_segments")


def pair_lookup(spark, sf_dir):
    found = encode.pair(D.segments(spark, sf_dir), 7, 31)
    return found.select("chrom", "sid1", "hid1", "sid2", "hid2", "pid1", "pid2")


def encode_segments(spark, sf_dir):
    found = encode.encode(D.raw(spark, sf_dir), D.samples(spark), D.sites(spark))
    return found.select("chrom", "sid1", F.col("hid1").cast("int").alias("hid1"), "sid2", F.col("hid2").cast("int").alias("hid2"), "pid1", "pid2")


def decode_segments(spark, sf_dir):
    found = encode.decode(D.segments(spark, sf_dir), D.samples(spark), D.sites(spark), D.chosen(spark, sf_dir))
    return found.select("sample1", "hap1", "sample2", "hap2", "chrom", "start_bp", "end_bp", _milli("cm"))


def sort_segments(spark, sf_dir):
    return encode.ordered(D.segments(spark, sf_dir)).select("chrom", "sid1", "hid1", "sid2", "hid2", "pid1", "pid2")


def map_slopes(spark, sf_dir):
    return genetic_map.with_slopes(D.map_points(spark)).select("chrom", "bp", F.round(F.col("slope") * 1e12).cast("bigint").alias("slope_pico"))


def map_to_cm(spark, sf_dir):
    asked = D.sites(spark).select("chrom", "bp")
    return genetic_map.to_cm(asked, D.map_points(spark)).select("chrom", "bp", F.round(F.col("cm") * 1e6).cast("bigint").alias("cm_micro"))


def map_to_bp(spark, sf_dir):
    asked = D.sites(spark).select("chrom", (F.col("pid") * 0.4).alias("cm"), "pid")
    return genetic_map.to_bp(asked, D.map_points(spark)).select("chrom", "pid", "bp")


def boundary_pids(spark, sf_dir):
    asked = D.sites(spark).select("chrom", (F.col("bp") - 500).alias("left_bp"), (F.col("bp") + 1000 * F.col("pid")).alias("right_bp"))
    return genetic_map.boundary_pids(asked, D.sparse_sites(spark)).select("chrom", F.col("left_bp").cast("bigint").alias("left_bp"), F.col("right_bp").cast("bigint").alias("right_bp"), "pid_left", "pid_right")


def density_regions(spark, sf_dir):
    return windows.density_regions(D.sparse_sites(spark)).select("chrom", "pid_s", F.col("label").cast("int").alias("label"))


def exclusion_overlay(spark, sf_dir):
    found = windows.exclude(windows.density_regions(D.sparse_sites(spark)), _ranges(spark))
    return found.select("chrom", "pid_s", F.col("label").cast("int").alias("label"))


def split_by_regions(spark, sf_dir):
    regions = windows.exclude(windows.density_regions(D.sparse_sites(spark)), _ranges(spark))
    pieces = cut.split(D.segments(spark, sf_dir), regions, D.sites(spark), LEAST)
    return pieces.select("chrom", "sid1", "hid1", "sid2", "hid2", "pid1", "pid2", F.col("label").cast("int").alias("label"))


def merge_by_length(spark, sf_dir):
    return merge.merge(D.segments(spark, sf_dir), D.sites(spark)).select("chrom", "sid1", "sid2", "pid1", "pid2")


def merge_by_genotypes(spark, sf_dir):
    blocks = genotypes.blocks(D.genotypes(spark))
    return merge.merge(D.segments(spark, sf_dir), D.sites(spark), blocks).select("chrom", "sid1", "sid2", "pid1", "pid2")


def discordance(spark, sf_dir):
    gaps = D.segments(spark, sf_dir).select("chrom", "sid1", "sid2", F.col("pid1").alias("gap_start"), F.col("pid2").alias("gap_end")).distinct()
    return genotypes.discordance(gaps, genotypes.blocks(D.genotypes(spark)))


def genome_wide_sum(spark, sf_dir):
    each = matrix.totals(D.segments(spark, sf_dir), LEAST, by_chrom=True)
    return matrix.add(each)


def total_band(spark, sf_dir):
    return matrix.band(total_by_pair(spark, sf_dir), 60.0, 90.0)


def total_subset(spark, sf_dir):
    return matrix.subset(total_by_pair(spark, sf_dir), D.chosen(spark, sf_dir))


def total_histogram(spark, sf_dir):
    return matrix.histogram(total_by_pair(spark, sf_dir), D.SAMPLES, 5.0).select("bin", "n_pairs")


def haplotype_strings(spark, sf_dir):
    return genotypes.haplotypes(D.genotypes(spark))


def triangle_cells(spark, sf_dir):
    at = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("nr")).distinct()
    cells = at.select("nr", S.triangle_row(F.col("nr")).alias("row"), S.triangle_col(F.col("nr")).alias("col"))
    return cells.withColumn("back", S.triangle_index(F.col("row"), F.col("col")))


def map_flat(spark, sf_dir):
    """Whether the map doesn't rise at each site."""
    return genetic_map.flat(D.sites(spark).select("chrom", "bp"), D.map_points(spark)).select("chrom", "bp", "is_flat")


def matrix_from_cells(spark, sf_dir):
    """A matrix given as the numbered cells of its lower triangle."""
    cells = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("nr"), (F.col("o_custkey") % 5).alias("cm10x"))
    return matrix.from_triangle(cells)


def cell_lookup(spark, sf_dir):
    return matrix.cell(total_by_pair(spark, sf_dir), 7, 31)


def totals_that_differ(spark, sf_dir):
    """Rows that two tables of totals don't share."""
    return compare.differences(total_by_pair(spark, sf_dir), total_bounded(spark, sf_dir))


def sample_ids(spark, sf_dir):
    """Names numbered by their first appearance."""
    names = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderkey").alias("nr"))
    return encode.samples(names)


def chromosome_upsert(spark, sf_dir):
    """Chromosomes with their lengths, some of them put anew."""
    known = D.sites(spark).groupBy("chrom").agg(F.max("bp").alias("length"))
    return compare.upsert(known, spark.createDataFrame([("N", 7), ("X", 9)], "chrom string, length int"), "chrom")


def record_counts(spark, sf_dir):
    """Segments, cells of the matrix and its greatest total."""
    totals = total_by_pair(spark, sf_dir).agg(F.count("*").alias("n_cells"), F.max("cm10x").alias("greatest"))
    return totals.withColumn("n_segments", D.segments(spark, sf_dir).agg(F.count("*").alias("n")).scalar())


_SQL = {
    total_by_pair: f"with {_TOTALS} select * from totals",
    total_by_haplotype_pair: f"""with {_SEG} select cast(sid1 * 2 + hid1 as int) as "row", cast(sid2 * 2 + hid2 as int) as col,
        cast(sum(cast(round((cm2 - cm1) * cast(10 as float)) as bigint)) as bigint) as cm10x
        from seg where cm2 - cm1 >= cast(0.5 as float) group by all""",
    total_bounded: f"""with {_SEG} select sid1 as "row", sid2 as col,
        cast(sum(cast(round((cm2 - cm1) * cast(10 as float)) as bigint)) as bigint) as cm10x
        from seg where cm2 - cm1 >= cast(0.5 as float) and cm2 - cm1 < cast(2.0 as float) group by all""",
    length_histogram: f"""with {_SEG}, h as (select cast(floor(cm2 - cm1) as int) as cm, count(*) as n from seg group by all),
        s as (select cast(unnest(range((select max(cm) from h) + 1)) as int) as cm)
        select cm, cast(coalesce(n, 0) as bigint) as n_segments from s left join h using (cm)""",
    site_density: f"with {_SPARSE}, {_DENSITY} select * from density",
    coverage: f"""with {_SEG}, w as (select cast(i as int) as win from range(cast(floor(cast(2560 as float) * cast(0.07 as float)) as bigint) + 2) t(i))
        select c.chrom, win, count(seg.chrom) as n_segments from w cross join {_CHROMS} c left join seg
        on seg.chrom = c.chrom and cast(win + 1 as float) > cm1 and cast(win as float) < cm2 group by all""",
    coverage_fine: f"""with {_SEG}, w as (select cast(i as int) as win from
        range(cast(floor((cast(2560 as float) * cast(0.07 as float))::double / 0.1::double) as bigint) + 2) t(i))
        select c.chrom, win, count(seg.chrom) as n_segments from w cross join {_CHROMS} c left join seg
        on seg.chrom = c.chrom and cast(0.1 as float) * cast(win + 1 as float) > cm1 and cast(0.1 as float) * cast(win as float) < cm2
        group by all""",
    coverage_of_subpopulation: f"""with {_SEG}, {_CHOSEN}, kept as (
            select * from seg where sid1 in (from chosen) and sid2 in (from chosen)),
        w as (select cast(i as int) as win from range(cast(floor(cast(2560 as float) * cast(0.07 as float)) as bigint) + 2) t(i))
        select c.chrom, win, count(kept.chrom) as n_segments from w cross join {_CHROMS} c left join kept
        on kept.chrom = c.chrom and cast(win + 1 as float) > cm1 and cast(win as float) < cm2 group by all""",
    pair_lookup: f"with {_SEG} select chrom, sid1, hid1, sid2, hid2, pid1, pid2 from seg where sid1 = 31 and sid2 = 7",
    encode_segments: f"with {_SEG} select chrom, sid1, hid1, sid2, hid2, pid1, pid2 from seg",
    decode_segments: f"""with {_SEG}, {_CHOSEN} select 's' || sid1 as sample1, hid1 + 1 as hap1, 's' || sid2 as sample2, hid2 + 1 as hap2, chrom,
        pid1 * 1000 + 1 as start_bp, pid2 * 1000 + 1 as end_bp, cast(round((cm2 - cm1) * cast(1000 as float)) as bigint) as cm_milli
        from seg where sid1 in (from chosen) and sid2 in (from chosen)""",
    sort_segments: f"with {_SEG} select chrom, sid1, hid1, sid2, hid2, pid1, pid2 from seg",
    map_slopes: f"with {_POINTS} select chrom, bp, cast(round(slope * 1e12) as bigint) as slope_pico from points",
    map_to_cm: f"""with {_SITES}, {_POINTS} select s.chrom, s.bp, cast(round(((s.bp - p.bp) * slope + p.cm) * 1e6) as bigint) as cm_micro
        from sites s asof join points p on s.chrom = p.chrom and s.bp >= p.bp""",
    map_to_bp: f"""with {_SITES}, {_POINTS}, asked as (select chrom, pid, pid * 0.4::double as cm from sites), found as (
            select a.chrom, a.pid, a.cm, max(p.bp) as bp from asked a join points p on a.chrom = p.chrom and p.cm <= a.cm group by all)
        select f.chrom, pid, cast(round(f.bp + coalesce((f.cm - p.cm) / nullif(slope, 0), 0)) as bigint) as bp
        from found f join points p on f.chrom = p.chrom and f.bp = p.bp""",
    boundary_pids: f"""with {_SPARSE}, asked as (select chrom, cast(d * 1000 + 1 - 500 as bigint) as left_bp, cast(d * 1000 + 1 + 1000 * d as bigint) as right_bp
            from range(2561) t(d), {_CHROMS})
        select a.chrom, left_bp, right_bp, cast(greatest(count(*) filter (bp <= left_bp) - 1, 0) as int) as pid_left,
        cast(count(*) filter (bp <= right_bp) as int) as pid_right from asked a join sites s using (chrom) group by all""",
    density_regions: f"with {_SPARSE}, {_REGIONS} select chrom, cast(pid_s as int) as pid_s, cast(label as int) as label from regions",
}
_OVERLAY = f"""{_SPARSE}, {_REGIONS}, {_RANGES}, cuts as (
        select chrom, pid_s as at from regions union select chrom, pid_left from ranges union select chrom, pid_right from ranges
    ), lab as (
        select c.chrom, c.at as pid_s, case when exists (select 1 from ranges x where x.chrom = c.chrom and x.pid_left <= c.at and c.at < x.pid_right)
               then 0 else (select arg_max(label, pid_s) from regions r where r.chrom = c.chrom and r.pid_s <= c.at) end as label
        from cuts c
    ), overlay as (select chrom, cast(pid_s as int) as pid_s, cast(label as int) as label from lab
        qualify label is distinct from lag(label) over (partition by chrom order by pid_s))"""
_ISLANDS = """, mark as (
        select *, case when before is null or (before < pid1 and not {closed}) then 1 else 0 end as starts from prev
    ), island as (
        select *, sum(starts) over (partition by chrom, sid1, sid2 order by pid1, pid2, before nulls first rows unbounded preceding) as nr from mark
    ) select chrom, sid1, sid2, cast(min(pid1) as int) as pid1, cast(max(pid2) as int) as pid2 from island group by chrom, sid1, sid2, nr"""
_PREV = _SEG + """, prev as (
        select *, max(pid2) over (partition by chrom, sid1, sid2 order by pid1, pid2 rows between unbounded preceding and 1 preceding) as before from seg
    )"""
_SHORT = "(cast(pid1 as float) * cast(0.07 as float) - cast(before as float) * cast(0.07 as float) <= cast(0.6 as float))"
_GT = """gt as (
        select cast(p as int) as pid, cast(s as int) as sid, case when (p * 7 + s * 13) % 3 = 0 then 0 else 1 end as a0,
               case when (p * 5 + s * 11) % 4 = 0 then 0 else 1 end as a1 from range(2561) t(p), range(50) u(s)
    )"""
_DIFFER = """x.a0 = x.a1 and y.a0 = y.a1 and x.a0 <> y.a0"""
_SQL |= {
    exclusion_overlay: f"with {_OVERLAY} select * from overlay",
    split_by_regions: f"""with {_OVERLAY}, {_SEG}, span as (select *, lead(pid_s) over (partition by chrom order by pid_s) as pid_e from overlay),
        piece as (select s.chrom, sid1, hid1, sid2, hid2, greatest(pid1, pid_s) as pid1, least(pid2, coalesce(pid_e, pid2)) as pid2, label
            from seg s join span r on s.chrom = r.chrom and pid_s <= pid2 and (pid_e is null or pid_e > pid1))
        select * from piece where cast(pid2 as float) * cast(0.07 as float) - cast(pid1 as float) * cast(0.07 as float) >= cast(0.5 as float)""",
    merge_by_length: f"with {_PREV}" + _ISLANDS.format(closed=_SHORT),
    merge_by_genotypes: f"""with {_PREV}, {_GT}, gap as (select distinct chrom, sid1, sid2, before, pid1 from prev where before < pid1 and {_SHORT}),
        bad as (select g.chrom, g.sid1, g.sid2, g.before, g.pid1, count(*) as n from gap g
            join gt x on x.sid = g.sid1 and x.pid > g.before and x.pid < g.pid1 join gt y on y.sid = g.sid2 and y.pid = x.pid
            where {_DIFFER} group by all having count(*) > 1)"""
    + _ISLANDS.format(closed=f"({_SHORT} and not exists (select 1 from bad where bad.chrom = prev.chrom and bad.sid1 = prev.sid1 and bad.sid2 = prev.sid2 and bad.before = prev.before and bad.pid1 = prev.pid1))"),
    discordance: f"""with {_SEG}, {_GT}, gap as (select distinct chrom, sid1, sid2, pid1 as gap_start, pid2 as gap_end from seg),
        inside as (select *, unnest(range(gap_start + 1, gap_end)) as pid from gap),
        bad as (select chrom, sid1, sid2, gap_start, gap_end, count(*) as n from inside i join gt x on x.pid = i.pid and x.sid = sid1
            join gt y on y.pid = i.pid and y.sid = sid2 where {_DIFFER} group by all)
        select gap.*, cast(coalesce(n, 0) as int) as n_discordant from gap left join bad using (chrom, sid1, sid2, gap_start, gap_end)""",
    genome_wide_sum: f"with {_TOTALS} select * from totals",
    total_band: f"with {_TOTALS} select * from totals where cm10x >= 600 and cm10x < 900",
    total_subset: f"""with {_TOTALS}, {_CHOSEN}, ids as (select sid, cast(row_number() over (order by sid) - 1 as int) as new from chosen)
        select r.new as "row", c.new as col, cm10x from totals join ids r on r.sid = "row" join ids c on c.sid = col""",
    total_histogram: f"""with {_TOTALS}, h as (select cast(floor(cm10x / 50) as int) as bin, count(*) as n from totals group by all),
        s as (select cast(unnest(range(cast(ceil((select max(cm10x) from totals) / 50.0) as bigint) + 1)) as int) as bin)
        select bin, cast(coalesce(n, 0) + case when bin = 0 then 50 * 49 / 2 - (select count(*) from totals) else 0 end as bigint) as n_pairs
        from s left join h using (bin)""",
    haplotype_strings: f"""with {_GT} select chrom, pid, string_agg(cast(a0 as varchar) || cast(a1 as varchar), '' order by sid) as haplotypes
        from gt, {_CHROMS} group by all""",
    triangle_cells: """select nr, r as "row", nr - r * (r - 1) // 2 as col, nr as back from (
        select distinct o_orderkey as nr, cast(floor((1 + sqrt(8 * o_orderkey + 1)) / 2) as bigint) as r from orders)""",
}
_SQL |= {
    map_flat: f"""with {_SITES}, {_POINTS} select s.chrom, s.bp, slope = 0 as is_flat
        from sites s asof join points p on s.chrom = p.chrom and s.bp >= p.bp""",
    matrix_from_cells: """select cast(r as int) as "row", cast(nr - r * (r - 1) // 2 as int) as col, cast(v as bigint) as cm10x from (
        select o_orderkey as nr, o_custkey % 5 as v, cast(floor((1 + sqrt(8 * o_orderkey + 1)) / 2) as bigint) as r from orders) where v <> 0""",
    cell_lookup: f"""with {_TOTALS} select * from totals where "row" = 31 and col = 7""",
    totals_that_differ: f"""with {_TOTALS}, bounded as (select sid1 as "row", sid2 as col, cast(sum(cast(round((cm2 - cm1) * cast(10 as float)) as bigint)) as bigint) as cm10x
            from seg where cm2 - cm1 >= cast(0.5 as float) and cm2 - cm1 < cast(2.0 as float) group by all),
        both_ as (select *, 1 as n from totals union all select *, -1 from bounded)
        select "row", col, cm10x, cast(sum(n) as bigint) as more_in_a from both_ group by all having sum(n) <> 0""",
    sample_ids: """select cast(row_number() over (order by min(o_orderkey)) - 1 as int) as sid, 'c' || o_custkey as name from orders group by o_custkey""",
    chromosome_upsert: f"""with {_SITES} select chrom, max(bp) as length from sites where chrom <> 'N' group by chrom union all select 'N', 7 union all select 'X', 9""",
    record_counts: f"""with {_TOTALS} select count(*) as n_cells, max(cm10x) as greatest, (select count(*) from seg) as n_segments from totals""",
}

QUERIES = {f.__name__: f for f in _SQL}
ORACLE_SQL = {f.__name__: sql for f, sql in _SQL.items()}
