"""Hand-computed cases and brute force for the segment operators."""

import random

import pytest
from pyspark.sql import functions as F

from kinspan.functions import scalars as S
from kinspan.operators import cut, encode, genetic_map, genotypes, matrix, merge, windows

# Hand-computed cases that any engine for these operators has to give.
SEGMENTS = [(0, 1), (0, 4), (2, 4), (0, 5), (5, 7), (3, 7), (0, 2), (2, 11), (3, 4), (4, 9), (0, 3)]


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([("1", k, k, float(k)) for k in range(12)], "chrom string, pid int, bp int, cm float")


@pytest.fixture(scope="module")
def segments(spark, sites):
    rows = [("1", 2 * k + 1, 0, 2 * k, 0, a, b) for k, (a, b) in enumerate(SEGMENTS)]
    return spark.createDataFrame(rows, "chrom string, sid1 int, hid1 int, sid2 int, hid2 int, pid1 int, pid2 int")


def test_split(spark, segments, sites):
    labels = spark.createDataFrame([("1", 0, 1), ("1", 1, 0), ("1", 2, 1), ("1", 5, 0), ("1", 8, 1)], "chrom string, pid_s int, label int")
    for bucket in (1, 3, 1024):
        found = {}
        for r in cut.split(segments, labels, sites, 2.0, bucket).collect():
            found.setdefault(r.sid2 // 2, []).append((r.pid1, r.pid2, r.label))
        found = {SEGMENTS[k]: sorted(v) for k, v in found.items()}
        assert found == {
            (0, 4): [(2, 4, 1)],
            (2, 4): [(2, 4, 1)],
            (0, 5): [(2, 5, 1)],
            (5, 7): [(5, 7, 0)],
            (3, 7): [(3, 5, 1), (5, 7, 0)],
            (2, 11): [(2, 5, 1), (5, 8, 0), (8, 11, 1)],
            (4, 9): [(5, 8, 0)],
        }


def test_coverage(segments, sites):
    found = windows.coverage(encode.with_cm(segments, sites), sites, 1.0).orderBy("win").collect()
    assert [r.n_segments for r in found] == [5, 4, 5, 6, 4, 4, 4, 2, 2, 1, 1, 0, 0]


@pytest.mark.parametrize(
    "left, right, expected",
    [
        (3, 4, [(1, 0), (2, 1), (3, 0), (4, 1), (5, 0), (11, 1), (15, 0), (18, 1)]),
        (2, 4, [(1, 0), (4, 1), (5, 0), (11, 1), (15, 0), (18, 1)]),
        (6, 8, [(1, 0), (2, 1), (5, 0), (11, 1), (15, 0), (18, 1)]),
        (6, 11, [(1, 0), (2, 1), (5, 0), (11, 1), (15, 0), (18, 1)]),
        (2, 13, [(1, 0), (13, 1), (15, 0), (18, 1)]),
        (3, 13, [(1, 0), (2, 1), (3, 0), (13, 1), (15, 0), (18, 1)]),
        (3, 7, [(1, 0), (2, 1), (3, 0), (11, 1), (15, 0), (18, 1)]),
        (2, 7, [(1, 0), (11, 1), (15, 0), (18, 1)]),
        (6, 15, [(1, 0), (2, 1), (5, 0), (18, 1)]),
        (6, 14, [(1, 0), (2, 1), (5, 0), (14, 1), (15, 0), (18, 1)]),
        (6, 20, [(1, 0), (2, 1), (5, 0), (20, 1)]),
    ],
)
def test_exclusion(spark, left, right, expected):
    start = [(1, 0), (2, 1), (5, 0), (11, 1), (15, 0), (18, 1)]
    regions = spark.createDataFrame([("1", p, v) for p, v in start], "chrom string, pid_s int, label int")
    ranges = spark.createDataFrame([("1", left, right)], "chrom string, pid_left int, pid_right int")
    assert [(r.pid_s, r.label) for r in windows.exclude(regions, ranges).orderBy("pid_s").collect()] == expected


@pytest.mark.parametrize("ids, expected", [([1, 2], [2]), ([0, 2], [1]), ([0, 3], [3]), ([1, 2, 4], [2, 7, 8]), ([2, 3, 4], [5, 8, 9])])
def test_subset(spark, ids, expected):
    cells = matrix.from_triangle(spark.createDataFrame([(k, k) for k in range(10)], "nr long, cm10x long"))
    found = matrix.subset(cells, spark.createDataFrame([(i,) for i in ids], "sid int"))
    by_cell = {(r.row, r.col): r.cm10x for r in found.collect()}
    assert [by_cell.get((i, j), 0) for i in range(len(ids)) for j in range(i)] == expected


def test_triangle(spark):
    pairs = [(i, j) for i in range(1, 60) for j in range(i)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "nr long, i int, j int")
    wrong = df.where((S.triangle_index(F.col("i"), F.col("j")) != F.col("nr")) | (S.triangle_row(F.col("nr")) != F.col("i")) | (S.triangle_col(F.col("nr")) != F.col("j")))
    assert wrong.count() == 0


def test_tokenizer(spark):
    lines = spark.createDataFrame([("1\t2\t\t3\t4",), ("0\t1\t2\t\t5\t4\t",)], "line string")
    assert [r[0] for r in lines.select(S.whole_numbers(F.col("line"))).collect()] == [[1, 2, 0, 3, 4], [0, 1, 2, 0, 5, 4]]


def test_map_inverse(spark):
    rng = random.Random(1)
    bp = sorted(rng.sample(range(1000, 10**7), 40))
    points = spark.createDataFrame([("1", b, float(k + 1)) for k, b in enumerate(bp)], "chrom string, bp long, cm double")
    asked = spark.createDataFrame([("1", rng.randrange(1, 10**7)) for _ in range(200)], "chrom string, bp long")
    there = genetic_map.to_cm(asked.withColumn("was", F.col("bp")), points)
    back = genetic_map.to_bp(there.drop("bp"), points)
    assert back.where(F.abs(F.col("bp") - F.col("was")) > 0).count() == 0 and back.count() == 200


def _random_segments(rng, n, samples=4, top=300):
    out = []
    for _ in range(n):
        a, b = rng.sample(range(samples), 2)
        start = rng.randrange(top - 40)
        out.append(("1", max(a, b), rng.randrange(2), min(a, b), rng.randrange(2), start, start + rng.randrange(1, 30)))
    return out + out[:10]  # repeated rows


def test_merge_against_brute_force(spark):
    rng = random.Random(7)
    top, cm = 300, 0.1
    rows = _random_segments(rng, 120)
    gt = {(p, s): (rng.randrange(2), rng.randrange(2)) for p in range(top) for s in range(4)}
    sites = spark.createDataFrame([("1", p, p, p * cm) for p in range(top)], "chrom string, pid int, bp int, cm float")
    segments = spark.createDataFrame(rows, "chrom string, sid1 int, hid1 int, sid2 int, hid2 int, pid1 int, pid2 int")
    blocks = genotypes.blocks(spark.createDataFrame([("1", p, s, *a) for (p, s), a in gt.items()], "chrom string, pid int, sid int, a0 int, a1 int"))
    site_cm = {r.pid: r.cm for r in sites.collect()}

    def islands(most_discordant):
        import numpy as np

        found = []
        for pair in sorted({(r[1], r[3]) for r in rows}):
            run = None
            for a, b in sorted((r[5], r[6]) for r in rows if (r[1], r[3]) == pair):
                if run is not None:
                    short = np.float32(site_cm[a]) - np.float32(site_cm[run[1]]) <= np.float32(0.6) if a > run[1] else True
                    bad = sum(1 for p in range(run[1] + 1, a) if len(set(gt[p, pair[0]])) == len(set(gt[p, pair[1]])) == 1 and gt[p, pair[0]] != gt[p, pair[1]])
                    if a <= run[1] or short and (most_discordant is None or bad <= most_discordant):
                        run[1] = max(run[1], b)
                        continue
                    found.append((*pair, *run))
                run = [a, b]
            found.append((*pair, *run))
        return sorted(found)

    for most in (None, 0, 1, 2):
        found = merge.merge(segments, sites, None if most is None else blocks, 0.6, most or 0)
        assert sorted((r.sid1, r.sid2, r.pid1, r.pid2) for r in found.collect()) == islands(most)


def test_missing_allele_inside_a_gap(spark):
    gaps = spark.createDataFrame([("1", 1, 0, 0, 3)], "chrom string, sid1 int, sid2 int, gap_start int, gap_end int")
    rows = [("1", p, s, 2 if (p, s) == (1, 0) else s, s) for p in range(4) for s in range(2)]
    blocks = genotypes.blocks(spark.createDataFrame(rows, "chrom string, pid int, sid int, a0 int, a1 int"))
    assert genotypes.discordance(gaps, blocks, "ignore").first().n_discordant == 1
    with pytest.raises(Exception, match="missing allele"):
        genotypes.discordance(gaps, blocks).collect()


def test_encode_decode_encode(spark, sites):
    samples = spark.createDataFrame([(0, "x"), (1, "y")], "sid int, name string")
    raw = spark.createDataFrame([("x", 1, "y", 2, "1", 2, 5), ("y", 0, "x", 1, "1", 3, 9)], "sample1 string, hap1 int, sample2 string, hap2 int, chrom string, start_bp int, end_bp int")
    first = encode.encode(raw, samples, sites)
    rows = sorted(tuple(r)[:7] for r in first.collect())
    assert rows == [("1", 1, 1, 0, 0, 2, 5), ("1", 1, 1, 0, 0, 3, 9)]
    assert sorted(tuple(r)[:7] for r in encode.encode(encode.decode(first, samples, sites), samples, sites).collect()) == rows
    with pytest.raises(Exception, match="unknown sample"):
        encode.encode(raw.withColumn("sample1", F.lit("z")), samples, sites).collect()


def test_empty_tables(spark, segments, sites):
    none = encode.with_cm(segments.limit(0), sites)
    assert windows.length_histogram(none).count() == 0
    assert matrix.totals(none).count() == 0
    assert merge.merge(none, sites).count() == 0
    assert [r.n_segments for r in windows.coverage(none, sites).collect()] == [0] * 13
    assert [r.n_pairs for r in matrix.histogram(matrix.totals(none), 5).collect()] == [10]


def test_errors_in_place_of_lost_rows(spark, segments, sites):
    regions = spark.createDataFrame([("1", 1, 1), ("1", 5, 0)], "chrom string, pid_s int, label int")
    for left, right in ((4, 3), (0, 3)):
        ranges = spark.createDataFrame([("1", left, right)], "chrom string, pid_left int, pid_right int")
        with pytest.raises(Exception, match="not a range"):
            windows.exclude(regions, ranges).collect()
    backward = spark.createDataFrame([("1", 1, 0, 0, 0, 5, 4)], segments.schema)
    with pytest.raises(Exception, match="from site 5 back to 4"):
        cut.split(backward, regions, sites).collect()
    cells = matrix.from_triangle(spark.createDataFrame([(k, k) for k in range(10)], "nr long, cm10x long"))
    with pytest.raises(ValueError, match="two samples"):
        matrix.subset(cells, spark.createDataFrame([(1,)], "sid int"))
    with pytest.raises(Exception, match="no such sample"):
        matrix.subset(cells, spark.createDataFrame([(1,), (5,)], "sid int"), d=5).collect()
    with pytest.raises(Exception, match="repeated id"):
        matrix.subset(cells, spark.createDataFrame([(1,), (1,)], "sid int")).collect()


def test_orders_of_segments(spark):
    rows = _random_segments(random.Random(9), 60)
    names = ["chrom", "sid1", "hid1", "sid2", "hid2", "pid1", "pid2"]
    df = spark.createDataFrame(rows, "chrom string, sid1 int, hid1 int, sid2 int, hid2 int, pid1 int, pid2 int").repartition(3)
    for by, order in (("pair", (0, 1, 3, 5, 6, 2, 4)), ("haplotype", (0, 1, 2, 3, 4, 5, 6))):
        found = [tuple(r) for r in encode.ordered(df, by).select(names).collect()]
        assert found == sorted(rows, key=lambda r: [r[k] for k in order])


def test_as_of_across_stretches(spark):
    rng = random.Random(4)
    points = sorted(rng.sample(range(0, 5 * 10**6), 12)) + [2 * 10**9]
    cm = [k * 1.5 for k in range(len(points))]
    known = spark.createDataFrame([("1", b, c) for b, c in zip(points, cm)], "chrom string, bp long, cm double")
    asked = [rng.randrange(0, 6 * 10**6) for _ in range(200)] + [10**9, 3 * 10**9] + points
    sites_ = known.select("chrom", F.col("bp"), (F.col("cm") / 1.5).cast("int").alias("pid"))
    found = genetic_map.sites_up_to(spark.createDataFrame([("1", b) for b in asked], "chrom string, bp long"), sites_).collect()
    assert sorted((r.bp, r.n_sites) for r in found) == sorted((b, sum(p <= b for p in points)) for b in asked)


@pytest.mark.parametrize("window", [2.0, 0.7, 0.1, 0.3])
def test_regions_by_density_against_brute_force(spark, window):
    """Region starts by the 32-bit product of a window's number and width, windows by division."""
    import numpy as np

    rng = random.Random(8)
    cm = sorted({np.float32(rng.choice([rng.uniform(0, 40), window * rng.randrange(60), np.float32(window) * np.float32(rng.randrange(60))])) for _ in range(300)})
    sites_ = spark.createDataFrame([("1", k, k, float(c)) for k, c in enumerate(cm)], "chrom string, pid int, bp int, cm float")
    for least in (2, 4):
        top = max(int(float(max(cm)) / window) + 1, 1)
        counts = [0] * (top + 1)
        for c in cm:
            counts[int(float(c) / window)] += 1
        found = {(r.pid_s, r.label) for r in windows.density_regions(sites_, window, least).collect()}
        starts, label = {}, None
        n_windows = windows.density(sites_, window).count()
        for win in range(n_windows):
            own = int((counts[win] if win < len(counts) else 0) >= least)
            if own != label:
                at = sum(c <= np.float32(window) * np.float32(win) for c in cm) - (own == 0)
                starts[0 if win == 0 else max(at, 0)] = own
                label = own
        want, label = set(), None
        for pid, own in sorted(starts.items()):
            if own != label:
                want.add((pid, own))
                label = own
        assert found == want
