"""Order of tasks under a deficit round robin, as a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(tasks: DataFrame, kind: str, order: str, quanta: dict[int, int]) -> DataFrame:
    """tasks with `cycle`, the round in which each starts: a class starts `quanta[class]` tasks a round, in order."""
    quantum = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in quanta.items() for x in kv]), F.col(kind))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(order)) - 1
    return tasks.withColumn("cycle", F.floor(place / quantum).cast("long"))


def size_class(mib: Column) -> Column:
    """fast, medium or heavy, by a file's size."""
    return F.when(mib < 5, "fast").when(mib < 30, "medium").otherwise("heavy")


def deadline_seconds(mib: Column) -> Column:
    return F.least(F.lit(300.0), F.lit(45.0) + F.lit(2.5) * mib)
