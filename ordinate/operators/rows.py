"""Ranges of rows: of a whole table in an order, or of each group.

A reverse range is the mirrored forward range over the descending order, so only forward ones are lowered. What is near
one end of the table is a top-k in that direction; everything else is a test of positions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordinate.names import free_names
from ordinate.operators.positions import as_order, require_unique, with_group_positions, with_positions
from ordinate.plans.ranges import Kind, Range, as_range
from ordinate.plans.translate import sql_bounds, sql_predicate
from ordinate.session import task_count

#: Rows that a task may hold for a top-k, and that all partitions may send to one task; a range that reaches further goes by positions.
TOP = 100_000
TOP_SENT = 4_000_000
#: Rows up to which Spark cuts groups before a shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000

LARGEST_LONG = (1 << 63) - 1


def mirrored(r: Range) -> Range:
    """The same elements, counted from the other end: a reverse range becomes a forward one over the reversed order."""
    return Range(~r.start, None if r.end is None else ~r.end, -r.step)


def descending(keys: list[Column]) -> list[Column]:
    """The keys' reverse order. Keys are plain: ascending, nulls first."""
    return [F.desc_nulls_last(k) for k in keys]


def select_rows(df: DataFrame, order_by: str | Sequence[str], text: Range | str, by: Sequence[str] = (), position: str | None = None, skewed: bool = False, unique: bool = False) -> DataFrame:
    """The rows of df at the positions of a range, in the ascending order of columns that tell all rows apart.

    by: columns whose groups are taken each on its own. position: a column to add, the row's 0-based place in the output
    (of its group); a column of that name is replaced. skewed: groups may be too large for one task. The result of a whole
    table is in output order where a position is not asked for; with one, order is what the column says.

    Rows that tie in order_by may change places from run to run. unique: look for such rows first, in a pass of its own, and
    raise OrderError if there are any.
    """
    r = as_range(text)
    keys = as_order(order_by)
    if unique:
        require_unique(df, [*([order_by] if isinstance(order_by, str) else order_by), *by])
    if r.kind is Kind.EMPTY:
        return _placed(df, position, F.lit(0)).limit(0)
    if r.kind is Kind.COPY and not position:
        return df
    if r.step < 0:
        r, ascending, keys = mirrored(r), keys, descending(keys)
    else:
        ascending = None
    if by:
        return _groups(df, list(by), keys, ascending, r, position, skewed)
    return _table(df, keys, ascending, r, position)


def _placed(df: DataFrame, position: str | None, value: Column) -> DataFrame:
    return df.withColumn(position, value.cast("bigint")) if position else df


def _opposite(keys: list[Column], ascending: list[Column] | None) -> list[Column]:
    return ascending if ascending is not None else descending(keys)


def _ordered(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df sorted: a sort has a fixed number of partitions, which a large input exceeds."""
    tasks = task_count(df)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.orderBy(*keys)
    return df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)


def _reach(df: DataFrame) -> int:
    """Rows from either end that a top-k may have: one task gets as many of each input partition."""
    sent = TOP_SENT // task_count(df)
    return TOP if sent >= TOP else max(sent, GROUP_LIMIT)


def _top(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """The first n rows; of very many partitions each is first cut to n rows, then each of some groups of them."""
    tasks = task_count(df)
    if n * tasks > TOP_SENT:
        salt, row = free_names(df, "salt", "row_of_salt")
        salted = df.withColumn(salt, F.spark_partition_id() % math.isqrt(tasks))
        first = F.row_number().over(Window.partitionBy(salt).orderBy(*keys))
        df = salted.withColumn(row, first).where(F.col(row) <= n).drop(salt, row)
    return df.orderBy(*keys).limit(n)


def _table(df: DataFrame, keys: list[Column], ascending: list[Column] | None, r: Range, position: str | None) -> DataFrame:
    start, end, step = r.start, r.end, r.step
    top = _reach(df)
    if start >= 0 and end is None and step == 1 and start == 0 and not position:
        return _ordered(df, keys)  # the whole table, reversed
    if start >= 0 and end is not None and 0 <= end <= top:
        if step == 1 and not position:
            first = _top(df, keys, end)
            return first.offset(start) if start else first
        return _numbered(_top(df, keys, end), keys, Range(start, None, step), position)
    if -top <= start < 0 and (end is None or end < 0):
        # The last rows by the opposite order, then their places counted within them: fewer rows than asked for are the whole table.
        last = _top(df, _opposite(keys, ascending), -start)
        if step == 1 and end is None and not position:
            return last.orderBy(*keys)
        return _numbered(last, keys, Range(0, end, step), position)
    if (start < 0 or end is not None and end < 0) and (r := r.resolve(n := df.count())).kind is Kind.EMPTY:
        return _placed(df, position, F.lit(0)).limit(0)
    if r != Range(start, end, step):
        if r.end is not None and r.end <= top:
            return _table(df, keys, ascending, r, position)
        if n - r.start <= top and r.end is None:
            return _numbered(_top(df, _opposite(keys, ascending), n - r.start), keys, Range(0, None, step), position)
    at, n_rows = free_names(df, "place", "rows", but=[position])
    numbered = with_positions(df, keys, at, n_rows)
    return _finished(_tested(numbered, r, at, n_rows, position).drop(n_rows), at, position)


def _finished(df: DataFrame, at: str, position: str | None) -> DataFrame:
    return df.drop(at) if position else _ordered(df, [F.col(at)]).drop(at)


def _numbered(df: DataFrame, keys: list[Column], r: Range, position: str | None) -> DataFrame:
    """A range over at most TOP rows."""
    everything = Window.partitionBy().orderBy(*keys)
    at, n = free_names(df, "place", "rows", but=[position])
    out = df.withColumns({at: F.row_number().over(everything).cast("bigint") - 1, n: F.count(F.lit(1)).over(Window.partitionBy())})
    out = _tested(out, r, at, n, position).drop(n)
    return out.drop(at) if position else out.orderBy(at).drop(at)


def _tested(df: DataFrame, r: Range, index: str, count: str, position: str | None) -> DataFrame:
    low, _ = sql_bounds(r, count)
    out = df.where(sql_predicate(r, index, count))
    return _placed(out, position, F.expr(f"({index} - {low}) div {min(r.step, LARGEST_LONG)}"))


def _groups(df: DataFrame, by: list[str], keys: list[Column], ascending: list[Column] | None, r: Range, position: str | None, skewed: bool) -> DataFrame:
    start, end, step = r.start, r.end, r.step
    row, n, other = free_names(df, "row_of_group", "rows_of_group", "other_row", but=[position])
    if skewed:
        # Positions are counted in ascending order; the descending ones follow from the group's size.
        if ascending is not None:
            numbered = with_group_positions(df, by, ascending, other, n).withColumn(row, F.col(n) - 1 - F.col(other)).drop(other)
        else:
            numbered = with_group_positions(df, by, keys, row, n)
        return _tested(numbered, r, row, n, position).drop(row, n)
    if step == 1 and start < 0 and (end is None or end < 0):
        # Counted from the far end no group size is needed, and a literal bound lets Spark cut groups before the shuffle.
        back = Window.partitionBy(*by).orderBy(*_opposite(keys, ascending))
        out = df.withColumn(other, F.row_number().over(back)).where((F.col(other) <= min(-start, LARGEST_LONG)) & (F.col(other) > (0 if end is None else min(-end, LARGEST_LONG))))
        if position:
            out = out.withColumn(position, F.row_number().over(Window.partitionBy(*by).orderBy(*keys)).cast("bigint") - 1)
        return out.drop(other)
    along = Window.partitionBy(*by).orderBy(*keys)
    if start >= 0 and (end is None or end >= 0):
        out = df.withColumn(row, F.row_number().over(along))
        if end is not None:
            out = out.where(F.col(row) <= min(end, LARGEST_LONG))
        out = out.where(F.col(row) > min(start, LARGEST_LONG))
        at = F.col(row) - 1 - min(start, LARGEST_LONG)
        if step > 1:
            out = out.where(at % min(step, LARGEST_LONG) == 0)
        return _placed(out, position, F.floor(at / min(step, LARGEST_LONG))).drop(row)
    if start >= 0 and step == 1 and -end < 1 << 31:
        # The row so many places on is there: no group size is needed.
        out = df.withColumns({row: F.row_number().over(along), other: F.lead(F.lit(1), -end).over(along)}).where(F.col(other).isNotNull() & (F.col(row) > min(start, LARGEST_LONG)))
        return _placed(out, position, F.col(row) - 1 - min(start, LARGEST_LONG)).drop(row, other)
    numbered = df.withColumns({row: F.row_number().over(along).cast("bigint") - 1, n: F.count(F.lit(1)).over(Window.partitionBy(*by))})
    return _tested(numbered, r, row, n, position).drop(row, n)


def head(df: DataFrame, order_by: str | Sequence[str], n: int, **options) -> DataFrame:
    return select_rows(df, order_by, Range(0, n), **options)


def offset(df: DataFrame, order_by: str | Sequence[str], n: int, **options) -> DataFrame:
    return select_rows(df, order_by, Range(n, None), **options)


def tail(df: DataFrame, order_by: str | Sequence[str], n: int, **options) -> DataFrame:
    return select_rows(df, order_by, Range(-n, None) if n else Range(0, 0), **options)


def drop_last(df: DataFrame, order_by: str | Sequence[str], n: int, **options) -> DataFrame:
    return select_rows(df, order_by, Range(0, -n if n else None), **options)


def every(df: DataFrame, order_by: str | Sequence[str], step: int, **options) -> DataFrame:
    return select_rows(df, order_by, Range(0, None, step), **options)


def reverse(df: DataFrame, order_by: str | Sequence[str], step: int = 1, **options) -> DataFrame:
    return select_rows(df, order_by, Range(-1, None, -step), **options)
