"""Media columns: archive directories as a Spark data source.

Writing: each task streams its members into archives (ZIP, members stored) in a directory that all executors share;
the driver's commit lists them in a manifest, so files of failed attempts are never read, and deletes those. Reading: the planner cuts
each listed archive into byte ranges; a task takes the members that start in its range, streams them in Arrow batches
of bounded bytes and, when one can't be read, opens the archive anew at that member's offset, without the others.
"""

from __future__ import annotations

import contextlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from kinspan.llm import _docs

FORMAT, MANIFEST = "media_archives", "_MANIFEST.json"
#: Bytes of an archive, of a planned range, of a streamed batch; attempts at a member.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 64 << 20, 16 << 20, 8 << 20, 3
#: Payload bytes are samples of an image this wide.
WIDTH, PAD = 576, 255
_PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, archive string, member_offset long, media binary"


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pyarrow.fs.LocalFileSystem(), path)


# --- The stored form: 8-bit grey PNG, losslessly compressed ---------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    """The text, and bytes 255 up to a positive multiple of WIDTH."""
    return text + bytes([PAD]) * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """payload: a positive multiple of WIDTH; n_bytes: how much of it is the text."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each starts with filter 0
    lines[:, 1:] = rows
    return b"".join(
        [
            _PNG,
            _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)),
            _chunk(b"tEXt", b"bytes\0%d" % n_bytes),
            _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)),
            _chunk(b"IEND", b""),
        ]
    )


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """The samples, by row, and how many bytes of them are the text. A damaged file raises ValueError."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG file")
    at, data, size, n_bytes = 8, [], None, None
    while at < len(media):
        length, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n_bytes = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image without interlacing")
    width, height = size[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines aren't supported")
    rows = lines[:, 1:]
    return rows, rows.size if n_bytes is None else n_bytes


def feature(rows: np.ndarray) -> str:
    """Size, mean and deviation of the samples, and a 64-bit hash of which of 64 stretches are above the mean."""
    flat = rows.reshape(-1).astype(np.int64)
    total, squares, n = int(flat.sum()), int((flat * flat).sum()), flat.size
    sums = np.add.reduceat(flat, np.arange(64) * n // 64)
    sizes = np.diff(np.append(np.arange(64) * n // 64, n))
    bits = np.packbits(sums * n > total * sizes).tobytes().hex()
    mean = total / n
    return f"{rows.shape[1]}x{rows.shape[0]};mean={mean:.3f};std={max(0.0, squares / n - mean * mean) ** 0.5:.3f};hash={bits}"


# --- The data source ------------------------------------------------------------------------------------------------


class Archives(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files  # name, bytes


class ArchiveWriter(DataSourceArrowWriter):
    """Takes doc_id and media."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        system, root = place(self.path)
        files: list[tuple[str, int]] = []
        out = archive = name = None

        def close():
            archive.close()
            files.append((name, out.tell()))
            out.close()

        number = 0
        try:
            for batch in iterator:
                for doc_id, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                    if archive is None:
                        name = f"part-{_docs.partition_id():06d}-{len(files):04d}-{uuid.uuid4().hex}.zip"
                        out = system.open_output_stream(f"{root}/{name}")
                        archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    info = zipfile.ZipInfo(f"{number:09d}/{'null' if doc_id is None else doc_id}.png")
                    archive.writestr(info, media or b"")
                    number += 1
                    if out.tell() >= ARCHIVE_BYTES:
                        close()
                        archive = None
            if archive is not None:
                close()
        except BaseException:  # the attempt ends here; so do its files
            if archive is not None:
                with contextlib.suppress(OSError, ValueError):
                    archive.close()
            if out is not None and not out.closed:
                out.close()
                files.append((name, 0))
            for written, _ in files:
                system.delete_file(f"{root}/{written}")
            raise
        return Archives(files)

    def commit(self, messages: list[Archives | None]) -> None:
        system, root = place(self.path)
        files = sorted(f for m in messages if m is not None for f in m.files)
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())
        self.clear({name for name, _ in files})

    def abort(self, messages: list[Archives | None]) -> None:
        self.clear(set())

    def clear(self, keep: set[str]) -> None:
        """Delete archives that lost attempts left behind: all but those named."""
        system, root = place(self.path)
        for info in system.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("part-") and info.base_name not in keep:
                system.delete_file(info.path)


class Range(InputPartition):
    def __init__(self, archive: str, start: int, stop: int):
        self.archive, self.start, self.stop = archive, start, stop


class Member:
    """One member, which can be read again from its offset alone."""

    def __init__(self, system: pyarrow.fs.FileSystem, path: str, info: zipfile.ZipInfo):
        self.system, self.path, self.info = system, path, info

    def read(self, archive: zipfile.ZipFile) -> bytes:
        for attempt in range(ATTEMPTS):
            try:
                if attempt == 0:
                    return archive.read(self.info)
                return self.read_alone()
            except (OSError, zipfile.BadZipFile, zlib.error, ValueError) as e:
                error = e
        raise OSError(f"{self.path} at {self.info.header_offset}: {ATTEMPTS} attempts failed") from error

    def read_alone(self) -> bytes:
        """From a new handle, by the local header at the member's offset."""
        with self.system.open_input_file(self.path) as f:
            f.seek(self.info.header_offset)
            head = f.read(30)
            if head[:4] != b"PK\x03\x04":
                raise zipfile.BadZipFile("no member here")
            name, extra = struct.unpack("<HH", head[26:30])
            f.seek(self.info.header_offset + 30 + name + extra)
            data = f.read(self.info.file_size)
        if zlib.crc32(data) != self.info.CRC:
            raise zipfile.BadZipFile("damaged member")
        return data


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        system, root = place(self.path)
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        return [
            Range(name, start, min(size, start + RANGE_BYTES))
            for name, size in files
            for start in range(0, size, RANGE_BYTES)
        ] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, root = place(self.path)
        path = f"{root}/{partition.archive}"
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            rows, held = [], 0
            for info in archive.infolist():
                if partition.start <= info.header_offset < partition.stop:
                    media = Member(system, path, info).read(archive)
                    key = info.filename.rsplit("/", 1)[1].removesuffix(".png")
                    rows.append((None if key == "null" else int(key), partition.archive, info.header_offset, media))
                    held += len(media)
                    if held >= BATCH_BYTES or len(rows) >= _docs.BATCH_ROWS:
                        yield self.batch(rows)
                        rows, held = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(directory); writing takes doc_id and media."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


# --- Operators ------------------------------------------------------------------------------------------------------


def encode(docs: DataFrame) -> DataFrame:
    """doc_id and media (the stored form of the text's payload) of each row of `docs` (doc_id, text)."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            media = [to_png(payload_of(t), len(t)) for t in _docs.utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

        return each

    return _docs.map_batches(_docs.texts(docs), make, "doc_id long, media binary")


def write_archives(media: DataFrame, directory: str) -> None:
    """Write doc_id and media into archives in a new directory that all executors share."""
    media.sparkSession.dataSource.register(MediaArchives)
    system, root = place(directory)
    system.create_dir(root, recursive=True)
    media.write.format(FORMAT).mode("append").save(directory)


def read_archives(spark: SparkSession, directory: str) -> DataFrame:
    """doc_id, archive, member_offset and media of every member."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format(FORMAT).load(directory)


def decode(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload, media and feature of each row of doc_id and media."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [from_png(m) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for _, n in found], pa.int64()),
                    pa.array([rows.tobytes() for rows, _ in found], pa.binary()),
                    batch.column(1),
                    pa.array([feature(rows) for rows, _ in found], pa.string()),
                ],
                names=["doc_id", "n_bytes", "payload", "media", "feature"],
            )

        return each

    return _docs.map_batches(
        media.select("doc_id", "media"), make, "doc_id long, n_bytes long, payload binary, media binary, feature string"
    )


def media_columns(docs: DataFrame, directory: str | None = None) -> DataFrame:
    """Store each text of `docs` (doc_id, text) in archives, and read payload, stored form and feature back.

    directory: a new one that all executors share; by default one below the session's checkpoint folder, which the
    caller may delete once the result is used. The archives are written at once, the result is read lazily.

    Null and empty texts have one row of padding. Rows with equal or null doc_id are members of their own. An empty
    table gives no rows. Further columns are not read.
    """
    spark = docs.sparkSession
    directory = directory or f"{_docs.shared_folder(spark)}/media-{uuid.uuid4().hex}"
    write_archives(encode(docs), directory)
    return decode(read_archives(spark, directory))
