"""Equality of tables, and small looks at them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that are more often in one table than in the other, with how much more often in `a`; column order aside."""
    names = sorted(a.columns)
    if names != sorted(b.columns):
        raise ValueError(f"columns differ: {names} and {sorted(b.columns)}")
    both = a.select(*names, F.lit(1).alias("_n")).unionByName(b.select(*names, F.lit(-1).alias("_n")))
    return both.groupBy(*names).agg(F.sum("_n").alias("more_in_a")).where("more_in_a <> 0")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return differences(a, b).isEmpty()


def head(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows in total order, whatever the partitions."""
    return df.orderBy(*df.columns).limit(n)


def tail(df: DataFrame, n: int = 10) -> DataFrame:
    """The last n rows in total order, the last one first."""
    return df.orderBy(*(F.col(c).desc() for c in df.columns)).limit(n)


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """`table` with `rows` in place of those of the same keys: chromosomes and their lengths."""
    return table.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)
