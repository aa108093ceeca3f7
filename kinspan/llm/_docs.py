"""What the document operators share: narrow inputs, bounded Arrow batches, a bounded cache."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch that reaches a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """The whole table, as the session's file system sees it."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a few very long texts can't fill a worker."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        try:
            now = spark.conf.get(key, None)
            if now is None or not 0 < _plain_bytes(now) <= most:
                spark.conf.set(key, str(most))
        except Exception as e:  # the key doesn't exist in this Spark
            if "CONF" not in str(e).upper():
                raise


def _plain_bytes(value: str) -> int:
    digits = value.rstrip("bBkKmMgG")
    unit = value[len(digits) :].lower().rstrip("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text as string, and the named further columns; nothing else of the input is read."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more
    )


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose function is built once in each task, so that models load on the executor."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list[bool]]]) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text the function built in each task keeps."""
    at = docs.columns.index("text")

    def build():
        keep = make()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield batch.filter(pa.array(keep(utf8(batch.column(at))), pa.bool_()))

        return each

    return map_batches(docs, build, docs.schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


class Cache(dict):
    """make(key) for each key of bytes; the last ones are kept, as far as they fit.

    Keys over LONGEST bytes are made anew each time. At about `most` bytes of keys and values what is kept becomes the
    old generation, and the one before goes, so that twice as much is held at most.
    """

    LONGEST, ENTRY = 256, 150

    def __init__(self, make: Callable, most: int = 48 << 20):
        super().__init__()
        self.make, self.most, self.held, self.old = make, most, 0, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += self.ENTRY + len(key) + getsizeof(value)
        self[key] = value
        return value


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def row_key(text="text"):
    """128 bits that stand for a text; with doc_id they tell rows apart, but for wholly equal ones."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def least_hashes(hashes: DataFrame, n: int, total: int) -> int | None:
    """A bound that about the n least distinct values of the long column `h` don't exceed; null with no row.

    total: rows of `hashes`. At most n values reach the driver. Whole equal rows count once.
    """
    def bound(df: DataFrame):
        return df.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]

    low, span = -(1 << 63), 1 << 64
    most = low + span * 4 * n // max(total, 1) if total > 4 * n else None
    found = bound(hashes.where(F.col("h") < most)) if most is not None else None
    return bound(hashes) if found is None else found


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, one in the warehouse, which executors share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables below the shared folder, as Parquet: cut off from their lineage, with their true sizes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", []

    def __call__(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = f"{self.folder}/{name}-{len(self.paths)}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, but_last: bool = False) -> None:
        """Delete all tables so named, or all but the last one of each name."""
        for name in names:
            own = [p for p in self.paths if p.rsplit("/", 1)[1].rsplit("-", 1)[0] == name]
            for path in own[: len(own) - but_last]:
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system Spark finds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
