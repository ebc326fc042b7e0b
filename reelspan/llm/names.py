"""Column names of any spelling, and names that a table does not have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(names: list[str], of: str = "") -> list[Column]:
    """Columns by their whole names, dots and backticks included; ``of``: the alias of their table."""
    return [F.col((of and of + ".") + quoted(c)) for c in names]


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that ``df`` has in no case of letters, and no two alike."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shape_of(df: DataFrame) -> str:
    """The columns of ``df`` as DDL."""
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
