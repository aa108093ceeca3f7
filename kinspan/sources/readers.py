"""Readers of text and binary inputs. Schemas are given, never inferred."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan import schema
from kinspan.operators import genotypes
from kinspan.sources import bgzf


def raw_segments(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Tab-separated segments without header, plain or gzip. lenient: a bad number is 0 in place of an error."""
    if not lenient:
        return spark.read.csv(path, sep="\t", schema=schema.RAW_SEGMENTS, mode="FAILFAST", enforceSchema=True)
    text = spark.read.csv(path, sep="\t", schema=", ".join(f"{p.split()[0]} string" for p in schema.RAW_SEGMENTS.split(", ")))
    kinds = dict(p.split() for p in schema.RAW_SEGMENTS.split(", "))
    return text.select(*(F.col(c) if k == "string" else F.coalesce(F.col(c).try_cast(k), F.lit(0).cast(k)).alias(c) for c, k in kinds.items()))


def genetic_map(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """Map points (chrom, bp, cm) of a space-separated file: chromosome, id, cM, bp. A tab in a line is an error."""
    lines = spark.read.text(path)
    safe = F.when(F.col("value").contains("\t"), F.raise_error(F.lit("a tab in a space-separated map"))).otherwise(F.col("value"))
    parts = F.split(F.trim(safe), " +")
    found = lines.where(F.trim("value") != "").select(parts[0].alias("chrom"), parts[3].cast("bigint").alias("bp"), parts[2].cast("double").alias("cm"))
    return found if chrom is None else found.withColumn("chrom", F.lit(chrom))


def names(spark: SparkSession, path: str) -> DataFrame:
    """name of each line that isn't empty: a list of samples."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def sids_of(listed: DataFrame, samples: DataFrame) -> DataFrame:
    """sid of each listed name, once; an unknown name is an error."""
    joined = listed.select("name").distinct().join(samples, "name", "left")
    known = F.when(F.col("sid").isNotNull(), F.col("sid")).otherwise(F.raise_error(F.concat(F.lit("unknown sample: "), F.col("name"))))
    return joined.select(known.alias("sid"))


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Lines kind, left, right, separated by tabs."""
    return spark.read.csv(path, sep="\t", schema=schema.EXCLUSIONS, mode="FAILFAST")


def vcf(spark: SparkSession, path: str, chrom: str, range_bytes: int = bgzf.RANGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """samples (sid, name), positions (chrom, bp) and genotypes (chrom, pid, sid, a0, a1) of a VCF text file.

    The file's own chromosome column isn't used. Of repeated positions the first variant stays. Lines keep their order
    in the file through the monotonic id of the scan. A block-compressed file (by name: .bgz, or .gz with such blocks)
    is read in ranges, any other compressed one by one task.
    """
    if path.endswith((".gz", ".bgz")) and bgzf.is_block_compressed(path):
        spark.dataSource.register(bgzf.BlockCompressed)
        lines = spark.read.format(bgzf.FORMAT).option("kind", "lines").option("rangebytes", range_bytes).load(path)
    else:
        lines = spark.read.text(path).withColumn("nr", F.monotonically_increasing_id())
    header = lines.where(F.col("value").startswith("#CHROM")).orderBy("nr").limit(1)
    fields = F.split("value", "\t")
    found = header.select(F.posexplode(F.slice(fields, 10, F.greatest(F.size(fields) - 9, F.lit(0)))).alias("nr", "name"))
    body = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        F.lit(chrom).alias("chrom"), "nr", fields[1].cast("int").alias("bp"), F.slice(fields, 10, F.greatest(F.size(fields) - 9, F.lit(0))).alias("calls")
    )
    first_seen = found.groupBy("name").agg(F.min("nr").cast("int").alias("sid")).select("sid", "name")
    return first_seen, body.select("chrom", "bp").distinct(), genotypes.long_form(body)


def matrix_file(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Sparse totals of binary matrix files, and what the first one's head says (haplotypes, d, subset).

    Each file is one flag byte, a 32-bit d, a 64-bit byte count with 32-bit ids, and a 64-bit byte count with the
    d * (d - 1) / 2 cells of the lower triangle. A cell has 16 bits, or 32 or 64 if that count is twice or four times as
    large; any other count is an error. Cells are turned into rows file by file on the executors.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1).to_pylist():
                _, _, _, values = _matrix(content)
                at = np.flatnonzero(values)
                for start in range(0, len(at), 1 << 20):
                    part = at[start : start + (1 << 20)]
                    row = ((1 + np.sqrt(8.0 * part + 1)) / 2).astype(np.int64)
                    row -= row * (row - 1) // 2 > part
                    row += row * (row + 1) // 2 <= part
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row.astype(np.int32)), pa.array((part - row * (row - 1) // 2).astype(np.int32)), pa.array(values[part].astype(np.int64))],
                        names=["row", "col", "cm10x"],
                    )

    first = files.select(F.col("path").alias("path")).orderBy("path").limit(1)
    size = struct.unpack_from("<Q", bytes(files.join(first, "path", "left_semi").select(F.substring("content", 6, 8).alias("n")).first().n))[0]
    head = files.join(first, "path", "left_semi").select(F.substring("content", 1, 13 + size).alias("content")).first()
    is_hap, d, ids, _ = _matrix(bytes(head.content), cells=False)
    return files.mapInArrow(cells, schema.TOTALS), {"haplotypes": bool(is_hap), "d": d, "subset": ids.tolist()}


def _matrix(content: bytes, cells: bool = True) -> tuple[int, int, np.ndarray, np.ndarray]:
    is_hap, d, size = struct.unpack_from("<BIQ", content)
    ids = np.frombuffer(content, "<u4", size // 4, 13)
    if not cells:
        return is_hap, d, ids, np.empty(0, "<u2")
    n, n_bytes = d * (d - 1) // 2, struct.unpack_from("<Q", content, 13 + size)[0]
    width = n_bytes // n if n else 2
    if width not in (2, 4, 8) or n * width != n_bytes:
        raise ValueError(f"{n_bytes} bytes for {n} cells")
    return is_hap, d, ids, np.frombuffer(content, f"<u{width}", n, 21 + size)


def coverage_file(spark: SparkSession, path: str) -> DataFrame:
    """path, win, cm (where it starts), n_segments and the width `window` of each binary coverage file.

    A file is a 32-bit width, a 64-bit n, n 32-bit starts and n 64-bit counts; it is read by one task, whatever the store.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                window, n = struct.unpack_from("<fQ", content)
                starts, counts = np.frombuffer(content, "<f4", n, 12), np.frombuffer(content, "<u8", n, 12 + 4 * n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(np.arange(n), pa.int32()), pa.array(starts, pa.float32()), pa.array(counts.astype(np.int64)), pa.array(np.full(n, window, np.float32))],
                    names=["path", "win", "cm", "n_segments", "window"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "path string, win int, cm float, n_segments bigint, window float")


def table(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    """A table that `writers.table` wrote. Only the folders of `chroms` and the columns used later are read."""
    found = spark.read.parquet(path)
    return found if chroms is None else found.where(F.col("chrom").isin(*chroms))
