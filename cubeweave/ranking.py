"""Gapless ranks within groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.scratch import materialize


def rank_in_groups(df: DataFrame, group: Sequence[str], order: Sequence[str], *, partitions: int | None = None, name: str = "rank") -> DataFrame:
    """Adds a long column: 0, 1, ... in each group in the given order, which should be total.

    The rows are range-partitioned by (group, order) and sorted, so a large group spreads over partitions;
    monotonically_increasing_id then holds a row's partition and its place there. One aggregate with a row for
    each (partition, group) gives the offsets. Nulls form groups of their own and sort first.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    mono = F.monotonically_increasing_id()
    kept = materialize(ordered.select("*", F.shiftright(mono, 33).alias("__pid"), mono.bitwiseAND(F.lit((1 << 33) - 1)).alias("__idx")), name)
    counts = kept.groupBy("__pid", *group).agg(F.min("__idx").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    keys = ["__pid", *group]
    offsets = counts.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(keys)], shift.alias("__shift"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate(keys)])
    joined = kept.join(offsets, same)
    return joined.select(*df.columns, (F.col("__idx") + F.col("__shift")).alias(name))


def values(spark, rows: Sequence[Sequence[int | bool]], names: Sequence[str]) -> DataFrame:
    """A small table of numbers and flags that the driver knows, as an SQL literal of longs and booleans."""
    cell = lambda x: str(x).upper() if isinstance(x, bool) else f"{x}L"
    return spark.sql("SELECT * FROM VALUES " + ",".join(f"({','.join(map(cell, r))})" for r in rows) + f" AS t({','.join(names)})")
