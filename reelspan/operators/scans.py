"""Running results over very long videos: a video's rows in list order are cut into stretches, and no window is longer than one.

Each stretch is reduced to one row; what it needs from all stretches before it (a maximum, a sum, the
state of a small automaton) is carried over the rows of a video's stretches, which are as many times fewer as a stretch has
rows; then each stretch is finished by itself.  Rows are dealt out once, by key and stretch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a stretch where list order is one number.
STRETCH = 512


def stretch_of(order: list[str], rows: int = STRETCH) -> Column:
    """Stretches by the first column of a list order, or by so many steps of it if it is the only one."""
    return F.col(order[0]) if len(order) > 1 else F.floor(F.col(order[0]) / rows)


#: Rows of a task, about, where ``dealt`` deals them out.
TASK_ROWS = 1 << 18


def dealt(rows: DataFrame, by: list[str], n_rows: int | None) -> DataFrame:
    """``rows`` dealt out by ``by`` over as many tasks as ``n_rows`` (about how many there are) asks for; where that is not known or one task, as the session's settings say.

    What sorts hold in a task then stays the same however large the table is, whatever ``spark.sql.shuffle.partitions`` is.
    """
    n = -(-(n_rows or 0) // TASK_ROWS)
    return rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism), *by) if n > 1 else rows


def before(line: WindowSpec) -> WindowSpec:
    return line.rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, key: str, summary: dict[str, Column], carry: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """``rows`` (with a column ``_stretch``) with what is carried into their stretch.

    ``summary``: aggregates of a stretch.  ``carry``: columns over the summaries of a key's stretches in order, one after another.
    """
    table = rows.groupBy(key, "_stretch").agg(*[c.alias(k) for k, c in summary.items()])
    names = []
    for name, column in carry(Window.partitionBy(key).orderBy("_stretch")).items():
        table = table.withColumn(name, column)
        names.append(name)
    own = [c for c in names if not c.startswith("__")]
    return rows.join(table.select(key, "_stretch", *own), [key, "_stretch"], "left")
