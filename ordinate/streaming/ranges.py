"""Ranges of streams: what can be told without the end of the input.

Windows and strides need a counter, a range that stops short of the end a queue of as many rows as it leaves out. Tails
and reversals need the end, which a stream does not have: take them from a table that the stream was written to.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ordinate.functions.selecting import RecordTooLarge
from ordinate.names import free_names
from ordinate.plans.modes import UsageError
from ordinate.plans.ranges import Kind, Range, as_range


def packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


#: Rows of a window's beginning that are held in memory while a micro-batch goes by; of longer ones only the keys are.
FIRST_ROWS = 100_000


def first_rows(batches: Iterator[pd.DataFrame], order_by: str, most: int) -> tuple[int, pd.DataFrame]:
    """How many rows there are, and the first of them by order_by. No more than these and a few batches are held."""
    seen, held, waiting = 0, None, []
    for batch in batches:
        seen += len(batch)
        waiting.append(batch)
        if sum(map(len, waiting)) > most:
            held, waiting = pd.concat([held, *waiting], ignore_index=True).sort_values(order_by, kind="stable", ignore_index=True).head(most), []
    return seen, pd.concat([held, *waiting], ignore_index=True).sort_values(order_by, kind="stable", ignore_index=True).head(most)


def placed(batches: Iterator[pd.DataFrame], order_by: str) -> tuple[int, Iterator[tuple[np.ndarray, pd.DataFrame]]]:
    """How many rows there are, and blocks of them with their places in the order of order_by.

    A single batch is one block in that order. Of more batches only the keys are held: the rows wait in a file, and come as they came.
    """
    first = next(batches)
    second = next(batches, None)
    if second is None:
        return len(first), iter([(np.arange(len(first)), first.sort_values(order_by, kind="stable", ignore_index=True))])
    spool, keys, sizes = tempfile.TemporaryFile(), [], []
    for batch in chain([first, second], batches):
        data = packed(batch)
        spool.write(data)
        keys.append(batch[order_by].to_numpy(copy=True))  # a view would keep the batch
        sizes.append((len(batch), len(data)))
    values = np.concatenate(keys)
    keys.clear()
    # Missing values come last either way.
    order = values.argsort(kind="stable") if values.dtype.kind in "iufMm" else pd.Series(values).sort_values(kind="stable").index.to_numpy()
    del values
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))

    def blocks() -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
        at = 0
        with spool:
            spool.seek(0)
            for rows, size in sizes:
                yield places[at:at + rows], unpacked(spool.read(size))
                at += rows

    return len(order), blocks()


def select_stream(stream: DataFrame, order_by: str, text: Range | str, by: Sequence[str] = (), record: str | None = None, max_record_size: int | None = None) -> DataFrame:
    """The rows of a stream at the positions of a range, in append mode.

    Rows must come in the order of order_by from one micro-batch to the next (one ordered source, or a sequence column);
    within a micro-batch they are placed by it, but may be given out in another order. by: columns whose groups are taken each on its own, side by side; without
    them a stream's positions are one sequence and one task counts them, holding the keys of a micro-batch in memory, or
    the rows up to the end of a window. Of a range with an end -m the last m rows so far
    are held back, and are never given out if no more come. max_record_size: bytes that the record, a string or binary
    column, may have in rows that such a range holds back; a larger one fails the query with RecordTooLarge.
    """
    r = as_range(text)
    if r.kind is Kind.COPY:
        return stream
    if r.kind is Kind.EMPTY:
        return stream.where(F.lit(False))
    if r.kind in (Kind.TAIL, Kind.REVERSE):
        raise UsageError(f"{r} depends on the end of the input: write the stream to a table and take the range of that")
    names = stream.columns
    place, everything = free_names(stream, "place", "all_rows")
    start, step = r.start, r.step
    held_back = -r.end if r.kind is Kind.LAG else 0
    end = r.end if r.end is not None and r.end >= 0 else None

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, queue = state.get if state.exists else (0, None)
        if end is not None and seen >= end:
            return
        before, batches = seen, (batch[names] for batch in batches)
        if end is not None and end - seen <= FIRST_ROWS:
            n, rows = first_rows(batches, order_by, end - seen)
            blocks = iter([(np.arange(len(rows)), rows)])
        else:
            n, blocks = placed(batches, order_by)
        seen += n
        waiting = []
        if queue is not None:
            held = unpacked(bytes(queue))
            ready = held[place] < seen - held_back
            waiting.append(held[~ready])
            yield held[ready][names]
        for at, rows in blocks:
            at = at + before
            chosen = (at >= start) & ((at - start) % step == 0)
            if end is not None:
                chosen &= at < end
            out = rows[chosen]
            if held_back:
                if max_record_size is not None and record and (out[record].dropna().map(lambda v: len(v.encode() if isinstance(v, str) else v)) > max_record_size).any():
                    raise RecordTooLarge(max_record_size)
                out = out.assign(**{place: at[chosen]})
                ready = out[place] < seen - held_back
                waiting.append(out[~ready])
                out = out[ready]
            yield out[names]
        if held_back:
            queue = packed(pd.concat(waiting, ignore_index=True).sort_values(place, ignore_index=True))
        state.update((seen, queue))

    keyed = stream if by else stream.withColumn(everything, F.lit(0))
    return keyed.groupBy(*(by or [everything])).applyInPandasWithState(count, stream.schema, "seen long, queue binary", "append", GroupStateTimeout.NoTimeout)
