"""Sinks: tables as Parquet, results as text with their leading comment lines, dense matrices behind a size check."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a dense matrix that may come to the driver.
DENSE_CELLS = 50_000_000


def write_bytes(spark: SparkSession, path: str, parts: list[bytes | memoryview]) -> None:
    """One binary file, in whatever file system Spark finds the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        for part in parts:
            for start in range(0, len(part), 1 << 22):
                out.write(bytearray(part[start : start + (1 << 22)]))
    finally:
        out.close()


def table(df: DataFrame, path: str) -> None:
    """Parquet, a folder for each chromosome if there is one."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("chrom") if "chrom" in df.columns else writer).parquet(path)


def labelled_segments(pieces: DataFrame, path: str) -> None:
    """Cut segments in a folder for each label and chromosome, written in one pass."""
    pieces.write.mode("overwrite").partitionBy("label", "chrom").parquet(path)


def decoded(df: DataFrame, path: str, compressed: bool = True) -> None:
    """Tab-separated text without header: names, haplotypes, chromosome, positions, length."""
    columns = ["sample1", "hap1", "sample2", "hap2", "chrom", "start_bp", "end_bp", "cm"]
    df.select(*columns).write.mode("overwrite").csv(path, sep="\t", compression="gzip" if compressed else "none")


def text(df: DataFrame, path: str, comments: list[str], columns: list[str], order: list[str]) -> None:
    """Comment lines, a header and rows, in one file: for reports of a row per window or bin."""
    spark = df.sparkSession
    head = spark.createDataFrame([(k, c) for k, c in enumerate([*(f"# {c}" for c in comments), "\t".join(columns)])], "nr int, value string")
    rows = df.select(F.lit(len(comments) + 1).alias("nr"), F.struct(*order).alias("at"), F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value"))
    head = head.select("nr", F.lit(None).cast(rows.schema["at"].dataType).alias("at"), "value")
    head.unionByName(rows).orderBy("nr", "at").coalesce(1).select("value").write.mode("overwrite").text(path)


def histogram_text(hist: DataFrame, path: str, d: int, nonzero: int | None = None) -> None:
    """nonzero: pairs whose total is a bin or more; by default counted."""
    if nonzero is None:
        nonzero = hist.where("bin > 0").agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0]
    text(hist, path, [f"pairs: {d * (d - 1) // 2}", f"pairs of a bin or more: {nonzero}", f"samples: {d}"], ["cm", "n_pairs"], ["bin"])


def coverage_text(coverage: DataFrame, path: str, window: float, records: int) -> None:
    text(coverage, path, [f"window: {window}", f"records processed: {records}", "coverage"], ["chrom", "cm", "n_segments"], ["chrom", "win"])


def density_text(density: DataFrame, path: str, window: float) -> None:
    text(density, path, [f"window: {window}", "sites in each window", "density"], ["chrom", "cm", "n_sites"], ["chrom", "win"])


def label_text(labels: DataFrame, sites: DataFrame, path: str) -> None:
    """chrom, pid, position, cM and label of each region; one past the last site has no position."""
    placed = labels.join(sites.select("chrom", F.col("pid").alias("pid_s"), "bp", "cm"), ["chrom", "pid_s"], "left")
    text(placed, path, [], ["chrom", "pid_s", "bp", "cm", "label"], ["chrom", "pid_s"])


def stat_text(hist: DataFrame, path: str) -> None:
    text(hist, path, ["segments by length"], ["cm", "n_segments"], ["cm"])


def dense(totals: DataFrame, d: int, most_cells: int = DENSE_CELLS) -> np.ndarray:
    """The symmetric matrix in cM with a zero diagonal, on the driver; refused beyond most_cells."""
    if d * d > most_cells:
        raise ValueError(f"{d} x {d} cells are more than {most_cells}")
    out = np.zeros((d, d))
    for row, col, cm10x in totals.select("row", "col", "cm10x").toLocalIterator():
        out[row, col] = out[col, row] = cm10x / 10
    return out


def matrix_file(totals: DataFrame, d: int, path: str, haplotypes: bool = False, subset: tuple[int, ...] = (), most_cells: int = DENSE_CELLS) -> None:
    """The binary form of `readers.matrix_file`: cells of 16 bits, or where a total is beyond that all of 32, or of 64."""
    if d * (d - 1) // 2 > most_cells:
        raise ValueError(f"more than {most_cells} cells")
    cells, bits = np.zeros(d * (d - 1) // 2, "<u2"), 16
    for row, col, cm10x in totals.select("row", "col", "cm10x").toLocalIterator():
        if cm10x >> bits:
            if cm10x < 0:
                raise OverflowError(f"total of {row}, {col}: {cm10x}")
            bits = 64 if cm10x >> 32 else 32
            cells = cells.astype(f"<u{bits // 8}")
        cells[row * (row - 1) // 2 + col] = cm10x
    ids = np.array(subset, "<u4")
    head = struct.pack("<BIQ", haplotypes, d, ids.nbytes) + ids.tobytes() + struct.pack("<Q", cells.nbytes)
    write_bytes(totals.sparkSession, path, [head, cells.view(np.uint8).data])


def coverage_file(coverage: DataFrame, path: str, window: float, most_windows: int = DENSE_CELLS) -> None:
    """The binary form of `readers.coverage_file`, of one chromosome's windows in order."""
    rows = coverage.select("win", "cm", "n_segments").orderBy("win").limit(most_windows + 1).collect()
    if len(rows) > most_windows:
        raise ValueError(f"more than {most_windows} windows")
    starts, counts = np.array([r.cm for r in rows], "<f4"), np.array([r.n_segments for r in rows], "<u8")
    write_bytes(coverage.sparkSession, path, [struct.pack("<fQ", window, len(rows)), starts.tobytes(), counts.tobytes()])


def matrix_name(prefix: str, low_cm: float = 0.0, high_cm: float = 6553.5) -> str:
    """The file's name says which band it was filtered to."""
    return f"{prefix}.mat" if int(low_cm * 10) == 0 and int(high_cm * 10) >= 65535 else f"{prefix}_{low_cm:.6f}_{high_cm:.6f}.mat"
