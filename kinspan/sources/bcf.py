"""Genotypes from binary variant files: block-compressed ones in ranges, others a file to a task, of 2 GB at most."""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.schema import MISSING
from kinspan.sources import bgzf

#: Typed values: bytes of an integer by type code, and the value that ends a shorter vector.
SIZES = {1: "<i1", 2: "<i2", 3: "<i4"}
WIDTH = {0: 0, 1: 1, 2: 2, 3: 4, 5: 4, 7: 1}


def typed(data: bytes, at: int) -> tuple[int, int, int]:
    """Kind and length of a typed value, and where it starts."""
    kind, length = data[at] & 15, data[at] >> 4
    at += 1
    if length == 15:
        inner, _, start = typed(data, at)
        length = int(np.frombuffer(data, SIZES[inner], 1, start)[0])
        at = start + WIDTH[inner]
    return kind, length, at


def dictionary(header: str) -> list[str]:
    """Names of filters, infos and formats by index."""
    found: dict[int, str] = {0: "PASS"}
    seen = {"PASS"}
    for line in header.split("\n"):
        if m := re.match(r"##(?:FILTER|INFO|FORMAT)=<.*?\bID=([^,>]+)", line):
            if m[1] in seen:
                continue
            seen.add(m[1])
            index = re.search(r"\bIDX=(\d+)", line)
            found[int(index[1]) if index else max(found) + 1] = m[1]
    return [found.get(k, "") for k in range(max(found) + 1)]


def records(content: bytes) -> tuple[list[str], Iterator[tuple[int, np.ndarray]]]:
    """Sample names; for each variant its 1-based position and alleles, two for each sample (0, 1, ... or MISSING)."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    if data[:3] != b"BCF":
        raise ValueError("not a BCF file")
    size = struct.unpack_from("<I", data, 5)[0]
    header = data[9 : 9 + size].rstrip(b"\0").decode()
    columns = next(x for x in header.split("\n") if x.startswith("#CHROM")).split("\t")
    names, fields = columns[9:], dictionary(header)

    def each() -> Iterator[tuple[int, np.ndarray]]:
        at = 9 + size
        while at < len(data):
            shared, own = struct.unpack_from("<II", data, at)
            pos = struct.unpack_from("<i", data, at + 12)[0]
            counts = struct.unpack_from("<I", data, at + 28)[0]
            here, end = at + 8 + shared, at + 8 + shared + own
            at = end
            while here < end:
                kind, _, start = typed(data, here)
                key = int(np.frombuffer(data, SIZES[kind], 1, start)[0])
                kind, length, start = typed(data, start + WIDTH[kind])
                n = (counts & 0xFFFFFF) * length
                here = start + n * WIDTH[kind]
                if fields[key] == "GT":
                    if length != 2:
                        raise ValueError(f"not diploid at {pos + 1}")
                    calls = np.frombuffer(data, SIZES[kind], n, start).reshape(-1, 2)
                    yield pos + 1, np.where(calls >> 1 > 0, (calls >> 1) - 1, MISSING)
                    break

    return names, each()


def bcf(spark: SparkSession, path: str, chrom: str, range_bytes: int = bgzf.RANGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `readers.vcf`, of one binary file. Of repeated positions the first variant stays."""
    if bgzf.is_block_compressed(path):
        spark.dataSource.register(bgzf.BlockCompressed)
        variants = spark.read.format(bgzf.FORMAT).option("kind", "variants").option("rangebytes", range_bytes).load(path)
        system, at = bgzf.place(path)
        with system.open_input_file(at) as f:
            header, _ = bgzf.header_of(f, system.get_file_info(at).size)
        found = list(dict.fromkeys(header.names))
        names = spark.createDataFrame(list(enumerate(found)), "sid int, name string")
    else:
        files = spark.read.format("binaryFile").load(path).select("content")
        variants, names = files.mapInArrow(_variants, "nr long, bp int, alleles binary"), files.mapInArrow(_names, "sid int, name string")
    # Of a position the first variant; then numbered by position, in one task for a chromosome, without the genotypes.
    first = variants.groupBy("bp").agg(F.min("nr").alias("nr"))
    numbered = first.withColumn("chrom", F.lit(chrom)).withColumn("pid", (F.row_number().over(Window.partitionBy("chrom").orderBy("bp")) - 1).cast("int"))
    placed = variants.join(numbered, ["bp", "nr"]).select("chrom", "pid", "alleles")
    genotypes = placed.mapInArrow(_long, "chrom string, pid int, sid int, a0 tinyint, a1 tinyint")
    return names, numbered.select("chrom", "bp"), genotypes


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0).to_pylist():
            found = list(dict.fromkeys(records(content)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found)], names=["sid", "name"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0).to_pylist():
            for nr, (bp, alleles) in enumerate(records(content)[1]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nr], pa.int64()), pa.array([bp], pa.int32()), pa.array([alleles.astype(np.int8).tobytes()], pa.binary())], names=["nr", "bp", "alleles"]
                )


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each sample of (chrom, pid, alleles)."""
    for batch in batches:
        for chrom, pid, packed in zip(*(batch.column(k).to_pylist() for k in range(3))):
            alleles = np.frombuffer(packed, np.int8).reshape(-1, 2)
            n = len(alleles)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chrom] * n, pa.string()), pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(alleles[:, 0].copy()), pa.array(alleles[:, 1].copy())],
                names=["chrom", "pid", "sid", "a0", "a1"],
            )
