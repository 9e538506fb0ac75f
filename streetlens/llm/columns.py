"""Columns of a table as one struct, whatever their names hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_row(names: list[str]) -> Column:
    """The columns as the struct ``row``; names may hold dots and backticks."""
    return F.struct(*[F.col(quoted(name)) for name in names]).alias("row")


def row_type(rows: DataFrame) -> str:
    """Type of the column ``row`` as text, for the schema of what tasks give back."""
    fields = rows.schema["row"].dataType.fields
    return "struct<" + ",".join(f"{quoted(f.name)}:{f.dataType.simpleString()}" for f in fields) + ">"
