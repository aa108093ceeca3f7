"""Block-compressed variant files read in ranges, as a Spark data source.

Such a file is a row of gzip blocks of 64 kB at most, each of which says how long it is. The planner cuts files into
byte ranges; a task takes the blocks that start in its range. A line or a binary record belongs to the range in which it
starts, but for a range's first line, which the range before reads to its end. Where a binary record starts isn't
marked, so a task looks for the first place in its range from which several records in a row make sense.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinspan.schema import MISSING

FORMAT = "block_compressed"
#: Bytes of a range; records in a row that have to make sense; rows of a batch.
RANGE_BYTES, CHAIN, BATCH = 32 << 20, 4, 4096
_HEAD = b"\x1f\x8b\x08\x04"
_MOST = 1 << 16


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


def _size(head: bytes) -> int | None:
    """The length of the block that starts with these bytes; none if they start no block."""
    if len(head) < 18 or head[:4] != _HEAD:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        kind, length = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and length == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    return None


def is_block_compressed(path: str) -> bool:
    system, at = place(path)
    with system.open_input_file(at) as f:
        return _size(f.read(64)) is not None


def _first_block(f, start: int, size: int) -> int:
    """The first place from `start` on at which a block starts that another one, or the end, follows."""
    f.seek(start)
    data, at = f.read(2 * _MOST + 64), -1
    while (at := data.find(_HEAD, at + 1)) >= 0:
        length = _size(data[at : at + 64])
        if length is not None:
            after = start + at + length
            f.seek(min(after, size))
            if after == size or _size(f.read(64)) is not None:
                return start + at
    return size


def blocks(f, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of each block that starts from `start` up to, not including, `stop`."""
    at = _first_block(f, start, size) if start else 0
    while at < stop:
        f.seek(at)
        raw = f.read(_MOST + 64)
        length = _size(raw)
        if length is None:
            raise ValueError(f"no block at {at}")
        extra = struct.unpack_from("<H", raw, 10)[0]
        yield at, zlib.decompress(raw[12 + extra : length - 8], -15)
        at += length


def lines(f, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(number, line): numbers rise along the file; they are the place of a line's block and in it."""
    rest, at, skip = b"", 0, start > 0
    for place_, data in blocks(f, start, size, size):
        past = place_ >= stop
        begin = 0
        while (end := data.find(b"\n", begin)) >= 0:
            number = at if rest else place_ << 16 | begin
            line, rest = rest + data[begin:end], b""
            begin = end + 1
            if skip:
                skip = False
            else:
                yield number, line
            if past:
                return
        if begin < len(data):
            at = at if rest else place_ << 16 | begin
            rest += data[begin:]
    if rest and not skip:
        yield at, rest


# --- Binary variants -------------------------------------------------------------------------------------------------


class Header:
    """Samples, contigs and the index of the genotype field, of a binary variant file's text header."""

    def __init__(self, text: str):
        from kinspan.sources import bcf

        columns = next(x for x in text.split("\n") if x.startswith("#CHROM")).split("\t")
        self.names, self.contigs = columns[9:], max(1, text.count("##contig=<"))
        self.genotype = [k for k, name in enumerate(bcf.dictionary(text)) if name == "GT"]


def header_of(f, size: int) -> tuple[Header, int]:
    """The header, and how many decompressed bytes come before the first record."""
    data, end = b"", None
    for _, part in blocks(f, 0, size, size):
        data += part
        if end is None and len(data) >= 9:
            if data[:3] != b"BCF":
                raise ValueError("not a BCF file")
            end = 9 + struct.unpack_from("<I", data, 5)[0]
        if end is not None and len(data) >= end:
            return Header(data[9:end].rstrip(b"\0").decode()), end
    raise ValueError("a header that doesn't end")


def _likely(data: bytes, at: int, header: Header) -> int | None:
    """Where the record ends that may start here; none if this can't be one."""
    if at + 32 > len(data):
        return None
    shared, own, chrom, pos, length = struct.unpack_from("<IIiii", data, at)
    alleles, counts = struct.unpack_from("<I", data, at + 24)[0] >> 16, struct.unpack_from("<I", data, at + 28)[0]
    fits = 24 <= shared < 1 << 24 and own < 1 << 30 and 0 <= chrom < header.contigs and pos >= -1 and length >= 0
    return at + 8 + shared + own if fits and 0 < alleles < 1 << 12 and counts & 0xFFFFFF == len(header.names) else None


def _synced(data: bytes, header: Header, ended: bool) -> int | None:
    """The first place from which CHAIN records in a row, or all up to the end, make sense."""
    for start in range(len(data) - 31):
        at = start
        for k in range(CHAIN):
            after = _likely(data, at, header)
            if after is None:
                break
            at = after
            if k == CHAIN - 1 or (ended and at == len(data)):
                return start
    return None


def records(f, start: int, stop: int, size: int, header: Header, first: int) -> Iterator[tuple[int, bytes]]:
    """(number, record) of each record that starts in the range. first: where the first record is, decompressed."""
    data, marks, skip, synced = b"", [], 0 if start else first, start == 0
    for place_, part in blocks(f, start, size, size):
        if place_ >= stop and not data:
            return
        marks.append((len(data), place_))
        data += part
        ended = place_ + _length(f, place_) >= size
        if not synced:
            at = _synced(data, header, ended)
            if at is None:
                if ended or len(data) > 64 << 20:
                    return
                continue
            data, marks, synced = data[at:], [(o - at, p) for o, p in marks], True
        if skip:
            gone = min(skip, len(data))
            skip -= gone
            data, marks = data[gone:], [(o - gone, p) for o, p in marks]
        at = 0
        while at + 8 <= len(data):
            end = at + 8 + sum(struct.unpack_from("<II", data, at))
            block, offset = max(((p, at - o) for o, p in marks if o <= at), default=(0, 0))
            if block >= stop:
                return
            if end > len(data):
                break
            yield block << 16 | offset, data[at:end]
            at = end
        data, marks = data[at:], [(o - at, p) for o, p in marks]
        marks = [m for k, m in enumerate(marks) if k + 1 == len(marks) or marks[k + 1][0] > 0]


def _length(f, at: int) -> int:
    f.seek(at)
    return _size(f.read(64)) or 0


def calls(record: bytes, header: Header) -> tuple[int, np.ndarray] | None:
    """1-based position and alleles, two for each sample; none for a record without genotypes."""
    from kinspan.sources import bcf

    shared = struct.unpack_from("<I", record)[0]
    pos, here = struct.unpack_from("<i", record, 12)[0], 8 + shared
    n = len(header.names)
    while here < len(record):
        kind, _, start = bcf.typed(record, here)
        key = int(np.frombuffer(record, bcf.SIZES[kind], 1, start)[0])
        kind, length, start = bcf.typed(record, start + bcf.WIDTH[kind])
        here = start + n * length * bcf.WIDTH[kind]
        if key in header.genotype:
            if length != 2:
                raise ValueError(f"not diploid at {pos + 1}")
            found = np.frombuffer(record, bcf.SIZES[kind], 2 * n, start).reshape(-1, 2)
            return pos + 1, np.where(found >> 1 > 0, (found >> 1) - 1, MISSING)
    return None


# --- The data source -------------------------------------------------------------------------------------------------


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, size: int):
        self.path, self.start, self.stop, self.size = path, start, stop, size


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, step: int):
        self.path, self.kind, self.step = path, kind, step

    def partitions(self) -> list[Range]:
        system, at = place(self.path)
        info = system.get_file_info(at)
        files = [info] if info.is_file else [i for i in system.get_file_info(pyarrow.fs.FileSelector(at)) if i.is_file and not i.base_name.startswith(("_", "."))]
        return [Range(i.path, s, min(s + self.step, i.size), i.size) for i in sorted(files, key=lambda i: i.path) for s in range(0, i.size, self.step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = place(self.path)
        with system.open_input_file(part.path) as f:
            if self.kind == "lines":
                rows = ((n, line.decode()) for n, line in lines(f, part.start, part.stop, part.size))
                yield from self.batches(rows, ("nr", pa.int64()), ("value", pa.string()))
            else:
                header, first = header_of(f, part.size)
                found = ((n, calls(r, header)) for n, r in records(f, part.start, part.stop, part.size, header, first))
                rows = ((n, c[0], c[1].astype(np.int8).tobytes()) for n, c in found if c is not None)
                yield from self.batches(rows, ("nr", pa.int64()), ("bp", pa.int32()), ("alleles", pa.binary()))

    @staticmethod
    def batches(rows: Iterator[tuple], *columns: tuple) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, (_, kind) in enumerate(columns)], names=[name for name, _ in columns])

        size = 0
        for row in rows:
            held.append(row)
            size += len(row[-1])
            if len(held) >= BATCH or size > 4 << 20:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class BlockCompressed(DataSource):
    """spark.read.format("block_compressed").option("kind", "lines" or "variants").load(path): nr and value, or bp and alleles."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "nr long, value string" if self.options.get("kind", "lines") == "lines" else "nr long, bp int, alleles binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("kind", "lines"), int(self.options.get("rangebytes", RANGE_BYTES)))
