"""Dense positions of rows, without a task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordinate.names import free_names
from ordinate.session import stored, task_count

#: Rows of a task in the number that monotonically_increasing_id() gives.
IN_TASK = (1 << 33) - 1


class OrderError(ValueError):
    """An order that does not tell rows apart."""


def as_order(order_by: str | Column | Sequence[str | Column]) -> list[Column]:
    keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def require_unique(df: DataFrame, order_by: str | Sequence[str]) -> None:
    """Raise unless the columns tell all rows apart: with ties a position could be another row's in the next run."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if not df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).groupBy(*(f"k{i}" for i in range(len(keys)))).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise OrderError(f"several rows have the same {', '.join(keys)}")


def with_positions(df: DataFrame, order_by: str | Column | Sequence[str | Column], index: str = "i", count: str | None = None) -> DataFrame:
    """df with its rows' 0-based positions in the order, and their number.

    Rows are range-partitioned by their input's size and sorted, numbered in their partition and written to the shared
    folder; a partition's first position is the number of rows in the ones before. The bounds of a range partitioning are
    sampled anew whenever it runs, so the two passes have to read the same written rows. Columns named like index and count
    are replaced.
    """
    keys = as_order(order_by)
    part, at, rows, start, total = free_names(df, "part_of_row", "place_in_part", "rows_of_part", "start_of_part", "rows_in_all", but=(index, count))
    ordered = df.repartitionByRange(task_count(df), *keys).sortWithinPartitions(*keys)
    held = stored(ordered.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit(IN_TASK))}), "positions")
    sizes = held.groupBy(part).agg(F.count(F.lit(1)).alias(rows))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select(part, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(start), F.sum(rows).over(Window.partitionBy()).alias(total))
    out = held.join(F.broadcast(starts), part).withColumn(index, F.col(start) + F.col(at))
    if count:
        out = out.withColumn(count, F.col(total))
    return out.drop(part, at, start, total)


def with_group_positions(df: DataFrame, by: Sequence[str], order_by: str | Column | Sequence[str | Column], index: str = "i", count: str | None = None) -> DataFrame:
    """df with its rows' positions in their group, however large a group is: from positions in the order of group and key."""
    place, least, size, *of = free_names(df, "place_in_all", "first_of_group", "rows_of_group", *(f"group_{k}" for k in range(len(by))), but=(index, count))
    numbered = stored(with_positions(df, [*map(F.col, by), *as_order(order_by)], place), "positions")
    first = stored(numbered.groupBy(*by).agg(F.min(place).alias(least), F.count(F.lit(1)).alias(size)), "groups").toDF(*of, least, size)
    same = F.lit(True)
    for k, other in zip(by, of):
        same = same & F.col(k).eqNullSafe(F.col(other))
    out = numbered.join(first, same).withColumn(index, F.col(place) - F.col(least))
    if count:
        out = out.withColumn(count, F.col(size))
    return out.select(*dict.fromkeys([*df.columns, index, *([count] if count else [])]))
