"""Column expressions that operators share. Lengths are 32-bit floats: their rounding is part of the results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def real(value: float | Column) -> Column:
    """A 32-bit float."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def length(start="cm1", end="cm2") -> Column:
    """Length in cM, as a 32-bit difference."""
    return F.col(end) - F.col(start)


def tenths(cm: Column) -> Column:
    """Whole tenths of a cM, half away from zero, from the 32-bit product."""
    return F.round(cm * real(10)).cast("bigint")


def encoded_hap(hap: Column) -> Column:
    """1 and 2 to 0 and 1; 0, of merged rows, to 1."""
    return (hap - 1).bitwiseAND(F.lit(1)).cast("tinyint")


def triangle_index(row: Column, col: Column) -> Column:
    """Place of a cell (row > col) in a lower triangle without diagonal."""
    row, col = row.cast("bigint"), col.cast("bigint")
    return (row * (row - 1) / 2).cast("bigint") + col


def triangle_row(index: Column) -> Column:
    guess = F.floor((1 + F.sqrt(8.0 * index.cast("double") + 1)) / 2).cast("bigint")
    below = (guess * (guess - 1) / 2).cast("bigint")
    above = (guess * (guess + 1) / 2).cast("bigint")
    return F.when(below > index, guess - 1).when(above <= index, guess + 1).otherwise(guess)


def triangle_col(index: Column) -> Column:
    row = triangle_row(index)
    return index - (row * (row - 1) / 2).cast("bigint")


def fields(line: Column, delimiter: str = "\t", most: int | None = None) -> Column:
    """Fields of a line; empty ones inside stay, an empty last one goes."""
    parts = F.split(line, f"\\Q{delimiter}\\E", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return parts if most is None else F.slice(parts, 1, most)


def whole_numbers(line: Column, delimiter: str = "\t") -> Column:
    """Fields as integers; one that isn't a number is 0."""
    return F.transform(fields(line, delimiter), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
