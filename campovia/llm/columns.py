"""Columns of any names: carried as one, by place, and laid out again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A top-level column by its very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def carried(columns: Sequence[str]) -> Column:
    """Some columns as one struct; its fields are named by place, so no name can clash or be misread. With no column it holds a null."""
    return F.struct(F.lit(None).cast("int").alias("none"), *(named(c).alias(f"at{i}") for i, c in enumerate(columns)))


def laid_out(of: str, columns: Sequence[str]) -> dict[str, Column]:
    """The carried columns again, by name; of: the struct's name."""
    return {c: F.col(f"{of}.at{i}").alias(c) for i, c in enumerate(columns)}
