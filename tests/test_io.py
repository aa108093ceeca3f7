"""Round trips through text, binary and Parquet."""

import numpy as np
import pytest

from kinspan.operators import genotypes, matrix
from kinspan.sources import readers, writers
from kinspan.streaming import totals as streaming


def test_raw_segments(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\t1\ty\t2\t1\t10\t20\t0.5\n\ny\t0\tx\t1\t1\t11\t30\t3\n")
    rows = readers.raw_segments(spark, str(tmp_path / "a.tsv")).collect()
    assert [(r.sample1, r.hap1, r.start_bp, r.end_bp) for r in rows] == [("x", 1, 10, 20), ("y", 0, 11, 30)]
    (tmp_path / "b.tsv").write_text("x\tq\ty\t2\t1\t10\t20\t0.5\n")
    assert readers.raw_segments(spark, str(tmp_path / "b.tsv"), lenient=True).first().hap1 == 0
    with pytest.raises(Exception):
        readers.raw_segments(spark, str(tmp_path / "b.tsv")).collect()


def test_vcf(spark, tmp_path):
    lines = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb", "9\t5\t.\tA\tC\t.\t.\t.\tGT\t0|1\t.|1", "9\t3\t.\tA\tC\t.\t.\t.\tGT:X\t1/1:4\t0/0:2", "9\t5\t.\tA\tG\t.\t.\t.\tGT\t1|1\t1|1"]
    (tmp_path / "v.vcf").write_text("\n".join(lines) + "\n")
    samples, positions, gt = readers.vcf(spark, str(tmp_path / "v.vcf"), "1")
    assert sorted(map(tuple, samples.collect())) == [(0, "a"), (1, "b")]
    assert sorted(r.bp for r in positions.collect()) == [3, 5]
    assert sorted(map(tuple, gt.collect())) == [("1", 0, 0, 1, 1), ("1", 0, 1, 0, 0), ("1", 1, 0, 0, 1), ("1", 1, 1, 2, 1)]
    assert [r.haplotypes for r in genotypes.haplotypes(gt).orderBy("pid").collect()] == ["1100", "0121"]


def test_matrix_file(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 7), (3, 1, 65535), (4, 3, 1)], "row int, col int, cm10x long")
    path = str(tmp_path / writers.matrix_name("m"))
    writers.matrix_file(cells, 5, path, subset=(2, 3))
    back, head = readers.matrix_file(spark, path)
    assert sorted(map(tuple, back.collect())) == [(1, 0, 7), (3, 1, 65535), (4, 3, 1)]
    assert head == {"haplotypes": False, "d": 5, "subset": [2, 3]}
    full = writers.dense(back, 5)
    assert np.array_equal(full, full.T) and full[3, 1] == 6553.5
    assert writers.matrix_name("m", 1.0, 2.0) == "m_1.000000_2.000000.mat"
    with pytest.raises(ValueError):
        writers.dense(cells, 5, most_cells=10)


def test_map_exclusions_and_names(spark, tmp_path):
    (tmp_path / "m.map").write_text("1 a 0.5 100\n1 b 1.5 300\n")
    assert sorted(map(tuple, readers.genetic_map(spark, str(tmp_path / "m.map")).collect())) == [("1", 100, 0.5), ("1", 300, 1.5)]
    (tmp_path / "t.map").write_text("1\ta 0.5 100\n")
    with pytest.raises(Exception, match="tab"):
        readers.genetic_map(spark, str(tmp_path / "t.map")).collect()
    (tmp_path / "e.tsv").write_text("cm\t1\t2\nBP\t100\t200\n")
    assert [r.kind for r in readers.exclusions(spark, str(tmp_path / "e.tsv")).collect()] == ["cm", "BP"]
    (tmp_path / "n.txt").write_text("a\n\nb\n")
    listed = readers.names(spark, str(tmp_path / "n.txt"))
    samples = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "sid int, name string")
    assert sorted(r.sid for r in readers.sids_of(listed, samples).collect()) == [0, 1]


def test_text_report(spark, tmp_path):
    hist = spark.createDataFrame([(1, 5), (0, 3)], "cm int, n_segments long")
    writers.stat_text(hist, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == "# segments by length\ncm\tn_segments\n0\t3\n1\t5\n"


def test_stream_totals(spark, tmp_path):
    rows = [("1", 1, 0, 0, 0, 0.0, 3.0), ("1", 1, 0, 0, 0, 5.0, 7.5), ("1", 2, 0, 0, 0, 0.0, 1.0)]
    kinds = "chrom string, sid1 int, hid1 int, sid2 int, hid2 int, cm1 float, cm2 float"
    batch = spark.createDataFrame(rows, kinds)
    batch.write.parquet(str(tmp_path / "in"))
    stream = streaming.totals(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("totals_now").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("totals_now").collect())) == sorted(map(tuple, matrix.totals(batch).collect())) == [(1, 0, 55)]


def test_bcf(spark, tmp_path):
    import gzip
    import struct

    from kinspan.sources import bcf

    header = '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="g">\n'
    header += "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n\0"

    def record(pos, calls):
        shared = struct.pack("<iiifII", 0, pos - 1, 1, 0.0, 2 << 16, 2 << 24 | 2) + b"\x07" + b"\x17A\x17C" + b"\x00"
        own = b"\x11\x01" + b"\x11\x05\x06"  # DP, a byte for each sample
        own += b"\x11\x02" + b"\x21" + bytes(calls)
        return struct.pack("<II", len(shared), len(own)) + shared + own

    body = record(5, [2, 5, 0, 5]) + record(3, [4, 4, 2, 2]) + record(5, [4, 4, 4, 4])
    data = b"BCF\x02\x02" + struct.pack("<I", len(header)) + header.encode() + body
    (tmp_path / "v.bcf").write_bytes(gzip.compress(data[:40]) + gzip.compress(data[40:]))
    samples, positions, gt = bcf.bcf(spark, str(tmp_path / "v.bcf"), "1")
    assert sorted(map(tuple, samples.collect())) == [(0, "a"), (1, "b")]
    assert sorted(r.bp for r in positions.collect()) == [3, 5]
    assert sorted(map(tuple, gt.collect())) == [("1", 0, 0, 1, 1), ("1", 0, 1, 0, 0), ("1", 1, 0, 0, 1), ("1", 1, 1, 2, 1)]


def test_tables_and_equality(spark, tmp_path):
    from kinspan.functions import compare

    a = spark.createDataFrame([("1", 1), ("2", 2), ("2", 2)], "chrom string, pid int")
    writers.table(a, str(tmp_path / "t"))
    assert compare.same_rows(a, readers.table(spark, str(tmp_path / "t")))
    assert readers.table(spark, str(tmp_path / "t"), ["2"]).count() == 2
    assert sorted(map(tuple, compare.differences(a, a.distinct()).collect())) == [("2", 2, 1)]
    assert [tuple(r) for r in compare.head(a, 1).collect()] == [("1", 1)] and compare.tail(a, 1).first().pid == 2
    put = compare.upsert(a.distinct(), spark.createDataFrame([("2", 9), ("3", 1)], "chrom string, pid int"), "chrom")
    assert sorted(map(tuple, put.collect())) == [("1", 1), ("2", 9), ("3", 1)]


def test_coverage_file(spark, tmp_path):
    rows = [("1", 1, 1.0, 7), ("1", 0, 0.0, 3)]
    writers.coverage_file(spark.createDataFrame(rows, "chrom string, win int, cm float, n_segments long"), str(tmp_path / "c.cov"), 1.0)
    assert sorted(tuple(r)[1:] for r in readers.coverage_file(spark, str(tmp_path / "c.cov")).collect()) == [(0, 0.0, 3, 1.0), (1, 1.0, 7, 1.0)]
    writers.coverage_file(spark.createDataFrame([], "chrom string, win int, cm float, n_segments long"), str(tmp_path / "d.cov"), 2.0)
    assert readers.coverage_file(spark, str(tmp_path / "d.cov")).count() == 0


def test_matrix_file_of_very_many_samples(spark, tmp_path):
    ids = tuple(range(300_000))
    (tmp_path / "m.mat").write_bytes(b"\0" + (0).to_bytes(4, "little") + (4 * len(ids)).to_bytes(8, "little") + np.array(ids, "<u4").tobytes() + (0).to_bytes(8, "little"))
    cells, head = readers.matrix_file(spark, str(tmp_path / "m.mat"))
    assert cells.count() == 0 and head["subset"] == list(ids)


@pytest.mark.parametrize("top, width", [(65535, 2), (65536, 4), (2**32 - 1, 4), (2**32, 8), (2**63 - 1, 8)])
def test_matrix_file_of_large_totals(spark, tmp_path, top, width):
    want = [(1, 0, 7), (2, 1, 65535), (3, 1, top), (4, 3, 1)]
    writers.matrix_file(spark.createDataFrame(want, "row int, col int, cm10x long"), 5, str(tmp_path / "m.mat"), subset=(2, 3))
    back, head = readers.matrix_file(spark, str(tmp_path / "m.mat"))
    assert sorted(map(tuple, back.collect())) == want and head == {"haplotypes": False, "d": 5, "subset": [2, 3]}
    assert (tmp_path / "m.mat").stat().st_size == 21 + 8 + 10 * width


def test_matrix_file_of_a_wrong_size_is_an_error(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 7), (4, 3, -1)], "row int, col int, cm10x long")
    with pytest.raises(OverflowError):
        writers.matrix_file(cells, 5, str(tmp_path / "m.mat"))
    for n_bytes in (18, 30, 0):
        path = tmp_path / f"{n_bytes}.mat"
        path.write_bytes(b"\0" + (5).to_bytes(4, "little") + bytes(8) + n_bytes.to_bytes(8, "little") + bytes(n_bytes))
        with pytest.raises(Exception, match=f"{n_bytes} bytes for 10 cells"):
            readers.matrix_file(spark, str(path))[0].collect()


def test_matrix_files_add_to_more_than_16_bits(spark, tmp_path):
    from kinspan.plans import recipes

    paths = [str(tmp_path / f"{k}.mat") for k in "ab"]
    for path, total in zip(paths, (65535, 70000)):
        writers.matrix_file(spark.createDataFrame([(1, 0, 7), (2, 1, total)], "row int, col int, cm10x long"), 3, path)
    assert sorted(map(tuple, recipes.matrix_files(spark, paths, str(tmp_path / "sum")).collect())) == [(1, 0, 14), (2, 1, 135535)]
    written = readers.matrix_file(spark, str(tmp_path / "sum.mat"))[0]
    assert sorted(map(tuple, written.collect())) == [(1, 0, 14), (2, 1, 135535)]


def test_matrix_files_are_added_and_subset_once(spark, tmp_path):
    from kinspan.plans import recipes

    cells = spark.createDataFrame([(1, 0, 7), (3, 1, 65), (4, 3, 30)], "row int, col int, cm10x long")
    paths = [str(tmp_path / f"{k}.mat") for k in "ab"]
    for path in paths:
        writers.matrix_file(cells, 5, path)
    sids = spark.createDataFrame([(1,), (3,), (4,)], "sid int")
    found = recipes.matrix_files(spark, paths, str(tmp_path / "sum"), 1.0, 99.0, sids)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 130), (2, 1, 60)]
    written = str(tmp_path / writers.matrix_name("sum", 1.0, 99.0))
    assert readers.matrix_file(spark, written)[1] == {"haplotypes": False, "d": 3, "subset": [1, 3, 4]}
    with pytest.raises(ValueError, match="subsets already"):
        recipes.matrix_files(spark, [written, written], str(tmp_path / "again"), sids=sids)
    with pytest.raises(ValueError):
        recipes.matrix_files(spark, paths[:1], str(tmp_path / "one"))


def _blocks(data, sizes):
    """Block-compressed bytes: blocks of the given numbers of bytes, by turns, and an empty last one."""
    import itertools
    import struct
    import zlib

    out, at = [], 0
    for size in itertools.chain(itertools.takewhile(lambda _: at < len(data), itertools.cycle(sizes)), [0]):
        part = data[at : at + size]
        at += size
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def test_block_compressed_lines_in_ranges(tmp_path):
    import io
    import random

    from kinspan.sources import bgzf

    rng = random.Random(2)
    wanted = [bytes(rng.choice(b"abcdef\x1f\x8b\x08\x04") for _ in range(rng.choice([0, 3, 40, 900]))) for _ in range(300)]
    for tail in (b"", b"\n"):
        data = _blocks(b"\n".join(wanted) + tail, [17, 300, 1, 2500])
        for step in (50, 333, 5000, len(data)):
            f, found = io.BytesIO(data), []
            for start in range(0, len(data), step):
                found += bgzf.lines(f, start, min(start + step, len(data)), len(data))
            assert [line for _, line in found] == wanted and [n for n, _ in found] == sorted({n for n, _ in found})


def test_block_compressed_variants_in_ranges(spark, tmp_path):
    import gzip
    import random
    import struct

    from kinspan.sources import bcf

    rng = random.Random(3)
    header = "##contig=<ID=1>\n##contig=<ID=2>\n" + '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="g">\n'
    header += "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\n\0"

    def record(pos):
        name = bytes(rng.choice(b"ACGT") for _ in range(rng.randrange(1, 14)))
        shared = struct.pack("<iiifII", 1, pos - 1, 1, 0.0, 2 << 16, 2 << 24 | 3) + b"\x07" + bytes([len(name) << 4 | 7]) + name + b"\x17C" + b"\x00"
        own = b"\x11\x01" + b"\x11\x05\x06\x07" + b"\x11\x02" + b"\x21" + bytes(rng.choice([0, 2, 3, 4, 5]) for _ in range(6))
        return struct.pack("<II", len(shared), len(own)) + shared + own

    body = b"".join(record(rng.randrange(1, 400)) for _ in range(500))
    plain = b"BCF\x02\x02" + struct.pack("<I", len(header)) + header.encode() + body
    (tmp_path / "whole.bcf").write_bytes(gzip.compress(plain))
    (tmp_path / "blocks.bcf").write_bytes(_blocks(plain, [700, 90, 1200, 5]))
    want = [sorted(map(tuple, df.collect())) for df in bcf.bcf(spark, str(tmp_path / "whole.bcf"), "1")]
    for step in (150, 1000, 1 << 20):
        found = bcf.bcf(spark, str(tmp_path / "blocks.bcf"), "1", step)
        assert [sorted(map(tuple, df.collect())) for df in found] == want
    assert len(want[0]) == 3 and len(want[1]) > 200 and len(want[2]) == 3 * len(want[1])


def test_block_compressed_vcf(spark, tmp_path):
    lines = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"] + [f"9\t{p}\t.\tA\tC\t.\t.\t.\tGT\t{p % 2}|1\t.|{k % 2}" for k, p in enumerate([5, 3, 5, 9, 3, 12])]
    text = ("\n".join(lines) + "\n").encode()
    (tmp_path / "v.vcf").write_bytes(text)
    (tmp_path / "v.vcf.gz").write_bytes(_blocks(text, [40, 7]))
    plain, packed = readers.vcf(spark, str(tmp_path / "v.vcf"), "1"), readers.vcf(spark, str(tmp_path / "v.vcf.gz"), "1", 60)
    for a, b in zip(plain, packed):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_reports_of_matrices_labels_and_views(spark, tmp_path):
    from kinspan.plans import recipes

    kinds = "chrom string, sid1 int, hid1 tinyint, sid2 int, hid2 tinyint, pid1 int, pid2 int, cm1 float, cm2 float"
    segments = spark.createDataFrame([("1", 1, 0, 0, 1, 0, 30, 0.0, 3.0), ("1", 2, 1, 0, 0, 0, 25, 0.0, 2.5), ("1", 2, 1, 1, 0, 0, 9, 0.0, 0.9)], kinds)
    read = lambda name: readers.matrix_file(spark, str(tmp_path / name))
    recipes.matrix_report(segments, 3, str(tmp_path / "s"))
    cells, head = read("s.mat")
    assert sorted(map(tuple, cells.collect())) == [(1, 0, 30), (2, 0, 25)] and head == {"haplotypes": False, "d": 3, "subset": []}
    lines = "".join(p.read_text() for p in (tmp_path / "s_hist").glob("part-*")).splitlines()
    assert lines[:4] == ["# pairs: 3", "# pairs of a bin or more: 2", "# samples: 3", "cm\tn_pairs"] and lines[4] == "0.0\t1"
    sids = spark.createDataFrame([(0,), (2,)], "sid int")
    recipes.matrix_report(segments, 3, str(tmp_path / "h"), haplotypes=True, sids=sids)
    cells, head = read("h.mat")
    assert sorted(map(tuple, cells.collect())) == [(3, 0, 25)] and head == {"haplotypes": True, "d": 4, "subset": [0, 2]}
    sites = spark.createDataFrame([("1", k, 100 * k + 1, k / 10) for k in range(60)], "chrom string, pid int, bp int, cm float")
    assert [(r.pid_s, r.label) for r in recipes.label_report(sites, str(tmp_path / "labels")).collect()] == [(0, 1)]
    assert "".join(p.read_text() for p in (tmp_path / "labels").glob("part-*")).splitlines()[1].split("\t")[:3] == ["1", "0", "1"]
    samples = spark.createDataFrame([(k, f"n{k}") for k in range(3)], "sid int, name string")
    recipes.view_report(segments, samples, sites, str(tmp_path / "view"), 0, 2)
    assert "".join(p.read_text() for p in (tmp_path / "view").glob("part-*")) == "n2\t1\tn0\t0\t1\t1\t2501\t2.5\n"
