"""Sums that don't depend on the order of segments, kept up to date over a stream of them.

Merging isn't among them: a late segment can join islands that were already given out. Run it on what `append` wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinspan.functions import scalars as S
from kinspan.operators import matrix


def totals(segments: DataFrame, least_cm: float = 2.0, most_cm: float | None = None, haplotypes: bool = False) -> DataFrame:
    """As `matrix.totals`, over a stream; write it in update or complete mode."""
    return matrix.totals(segments, least_cm, most_cm, haplotypes)


def lengths(segments: DataFrame) -> DataFrame:
    """cm, n_segments: segments by whole cM; without empty bins, which a stream can't know."""
    return segments.groupBy(F.floor(S.length()).cast("int").alias("cm")).agg(F.count("*").alias("n_segments"))


def append(segments: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch to a table of Parquet files, once."""
    return segments.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
