"""Ranges of a text or binary column, value by value, in expressions that stay in the JVM.

A string is taken as its code points. A binary value is taken as its Latin-1 image, in which each byte is one character,
so that malformed UTF-8 is as good as any other content.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinate.operators.rows import mirrored
from ordinate.plans.modes import LINES, Mode, Unit
from ordinate.plans.ranges import Kind, Range, as_range

MOST = (1 << 31) - 1

#: Well-formed UTF-8 in a Latin-1 image: one match a code point, or one a byte that belongs to none.
CODE_POINT = (
    r"(?s)[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
    r"|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}|."
)


class RecordTooLarge(ValueError):
    def __init__(self, limit: int):
        super().__init__(f"record exceeds --max-record-size={limit} bytes in line/delimiter/grapheme mode; use --max-record-size=unlimited to allow larger records")
        self.limit = limit


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: inside, it is a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bound(v: int, n: Column) -> Column:
    return F.greatest(n - min(-v, MOST), F.lit(0)) if v < 0 else F.least(F.lit(min(v, MOST)), n)


def bounds(r: Range, n: Column) -> tuple[Column, Column]:
    """Lowest position and number of positions that a forward range spans."""
    low = _bound(r.start, n)
    return low, F.greatest((n if r.end is None else _bound(r.end, n)) - low, F.lit(0))


def pick(elements: Column, text: Range | str) -> Column:
    """The selected elements of an array, in output order."""
    r = as_range(text)
    if r.kind is Kind.COPY:
        return elements
    if r.kind is Kind.EMPTY:
        return F.slice(elements, 1, 0)

    def of(a: Column) -> Column:
        forward = r
        if r.step < 0:
            a, forward = F.reverse(a), mirrored(r)
        low, span = bounds(forward, F.size(a))
        out = F.slice(a, low + 1, span)
        return F.filter(out, lambda _, i: i % min(forward.step, MOST) == 0) if forward.step > 1 else out

    return let(elements, of)


def _quoted(delimiter: str) -> str:
    return r"\Q" + delimiter.replace(r"\E", r"\E\\E\Q") + r"\E"


def _image(column: Column) -> Column:
    return F.decode(column.cast("binary"), "ISO-8859-1")


def _bytes(column: Column) -> Column:
    return F.encode(column, "ISO-8859-1")


def _parts(text: Column, delimiter: str) -> Column:
    """What stands between delimiters; a delimiter at the end is followed by an empty part."""
    return F.split(text, F.lit(_quoted(delimiter)), -1)


def _closed(parts: Column) -> Column:
    return F.element_at(parts, -1) == ""


def _content(parts: Column) -> Column:
    return F.slice(parts, 1, F.size(parts) - F.when(_closed(parts), 1).otherwise(0))


def _records(parts: Column, delimiter: str) -> Column:
    """The records with their delimiters; the last may have none."""
    return let(F.size(parts) - 1, lambda last: F.transform(_content(parts), lambda x, i: F.when(i < last, F.concat(x, F.lit(delimiter))).otherwise(x)))


def _select_records(text: Column, delimiter: str, r: Range) -> Column:
    def of(parts: Column) -> Column:
        if r.step > 0:
            return F.array_join(pick(_records(parts, delimiter), r), "")
        # Backwards, the delimiter that the last record lacks is missing at the end of the output.
        chosen = pick(_content(parts), r)
        low, span = bounds(mirrored(r), F.size(_content(parts)))
        ends = _closed(parts) | (low > 0)
        return F.when(parts.isNull(), F.lit(None)).when(span == 0, F.lit("")).otherwise(F.concat(F.array_join(chosen, delimiter), F.when(ends, F.lit(delimiter)).otherwise(F.lit(""))))

    return let(_parts(text, delimiter), of)


def _select_points(text: Column, r: Range, split: Callable[[Column], Column]) -> Column:
    """Of characters that `split` tells apart."""
    return F.array_join(pick(split(text), r), "")


def _select_chars(text: Column, r: Range) -> Column:
    """Of a string whose characters are the elements: no array is needed for a window or a reversal."""
    if r.step == -1:
        return let(F.reverse(text), lambda t: _select_chars(t, mirrored(r)))
    if r.step == 1:
        def window(t: Column) -> Column:
            low, span = bounds(r, F.char_length(t))
            return F.substring(t, low + 1, span)
        return let(text, window)
    return _select_points(text, r, lambda t: F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)))


def _strided(binary: Column, r: Range) -> Column:
    """The Latin-1 image of every so many bytes: only the selected ones are looked at."""
    forward = r if r.step > 0 else mirrored(r)

    def of(b: Column) -> Column:
        low, span = bounds(forward, F.octet_length(b))
        steps = F.sequence(F.lit(0), F.greatest(span, F.lit(1)) - 1, F.lit(min(forward.step, MOST)))
        place = (lambda k: low + k) if r.step > 0 else (lambda k: F.octet_length(b) - 1 - low - k)
        chosen = F.array_join(F.transform(steps, lambda k: F.decode(F.substring(b, place(k) + 1, 1), "ISO-8859-1")), "")
        return F.when(b.isNull(), F.lit(None)).when(span == 0, F.lit("")).otherwise(chosen)

    return let(binary, of)


#: Below U+0300 nothing joins a cluster but a line feed its carriage return.
_MAY_JOIN = re.compile("[\r\u0300-\U0010FFFF]")


def clusters(value: bytes | str) -> list[bytes] | list[str]:
    """Extended grapheme clusters; a byte that belongs to no code point is a cluster of its own and ends the one before."""
    import regex

    if isinstance(value, str):
        return regex.findall(r"\X", value) if _MAY_JOIN.search(value) else list(value)
    return [c.encode("utf-8", "surrogateescape") for c in regex.findall(r"\X", bytes(value).decode("utf-8", "surrogateescape"))]


def _by_value(of: Callable, kind: str) -> Callable[[Column], Column]:
    """A function of single values in Python. Values are pickled some hundred at a time: batches of Arrow are 10,000 rows, whatever their size."""
    return F.udf(lambda v: None if v is None else of(v), kind, useArrow=False)


def _select_graphemes(column: Column, r: Range, binary: bool) -> Column:
    part = slice(r.start, r.end, r.step)

    def cut(v: bytes | str) -> bytes | str:
        if isinstance(v, str) and not _MAY_JOIN.search(v):
            return v[part]
        return (b"" if binary else "").join(clusters(v)[part])

    return _by_value(cut, "binary" if binary else "string")(column)


def select_column(column: str | Column, text: Range | str, mode: Mode = LINES, binary: bool = False) -> Column:
    """The selected elements of each value, concatenated as they stand; null stays null.

    binary: the column is binary, and so is the result. By bytes the result is always binary.
    """
    column, r = F.col(column) if isinstance(column, str) else column, as_range(text)
    binary_out = binary or mode.unit is Unit.BYTES
    if r.kind is Kind.COPY:
        return column.cast("binary") if binary_out else column
    if r.kind is Kind.EMPTY:
        return F.when(column.isNotNull(), F.lit("").cast("binary") if binary_out else F.lit(""))
    if mode.unit is Unit.GRAPHEMES:
        return _select_graphemes(column, r, binary)
    if mode.unit is Unit.BYTES:
        if r.step == 1:
            def window(b: Column) -> Column:
                low, span = bounds(r, F.octet_length(b))
                return F.substring(b, low + 1, span)
            return let(column.cast("binary"), window)
        return _bytes(_select_chars(_image(column), r) if r.step == -1 else _strided(column.cast("binary"), r))
    if mode.unit is Unit.CHARS:
        if not binary:
            return _select_chars(column, r)
        return _bytes(_select_points(_image(column), r, lambda t: F.regexp_extract_all(t, F.lit(CODE_POINT), F.lit(0))))
    if binary:
        return _bytes(_select_records(_image(column), mode.delimiter.decode("latin-1"), r))
    try:
        delimiter = mode.delimiter.decode()
    except UnicodeDecodeError:  # no string holds it, but a part of one's bytes may
        return F.decode(_bytes(_select_records(_image(column), mode.delimiter.decode("latin-1"), r)), "UTF-8")
    return _select_records(column, delimiter, r)


def elements(column: str | Column, mode: Mode = LINES, binary: bool = False) -> Column:
    """The elements of each value as an array, delimiters kept: an array of binary if the column is, or by bytes."""
    column = F.col(column) if isinstance(column, str) else column
    if mode.unit is Unit.GRAPHEMES:
        return _by_value(clusters, "array<binary>" if binary else "array<string>")(column)
    if mode.delimited and not binary:
        return let(_parts(column, mode.delimiter.decode()), lambda p: _records(p, mode.delimiter.decode()))
    if mode.unit is Unit.CHARS and not binary:
        return F.regexp_extract_all(column, F.lit("(?s)."), F.lit(0))
    image = _image(column)
    if mode.delimited:
        found = let(_parts(image, mode.delimiter.decode("latin-1")), lambda p: _records(p, mode.delimiter.decode("latin-1")))
    else:
        found = F.regexp_extract_all(image, F.lit(CODE_POINT if mode.unit is Unit.CHARS else "(?s)."), F.lit(0))
    return F.transform(found, _bytes)


def largest_record(column: str | Column, text: Range | str, mode: Mode = LINES, binary: bool = False) -> Column | None:
    """Bytes of the largest record that a limit applies to; None where it never does.

    From the end: all records before a fixed end. Short of the end: the strided records from the start on, also those that
    the end drops. Backwards: all. By bytes and characters, and in ranges from the start alone: none.
    """
    r = as_range(text)
    if r.kind not in (Kind.TAIL, Kind.LAG, Kind.REVERSE) or mode.unit in (Unit.BYTES, Unit.CHARS):
        return None

    def of(records: Column) -> Column:
        if r.kind is Kind.TAIL and r.end is not None and r.end >= 0:
            records = F.slice(records, 1, min(r.end, MOST))
        elif r.kind is Kind.LAG:
            records = pick(records, Range(r.start, None, r.step))
        return F.array_max(F.transform(records, F.octet_length))

    return let(elements(column, mode, binary), of)


def select_texts(df: DataFrame, column: str, text: Range | str, mode: Mode = LINES, into: str | None = None, max_record_size: int | None = None) -> DataFrame:
    """df with the selected elements in place of the column's values. A record over the limit is looked for first, in a pass of its own: an expression that
    raises could be dropped or moved by the optimizer. Nothing is returned then, not even rows before it."""
    binary = dict(df.dtypes)[column] == "binary"
    if max_record_size is not None and (largest := largest_record(column, text, mode, binary)) is not None:
        worst = df.agg(F.max(largest).alias("worst")).first()["worst"]
        if worst is not None and worst > max_record_size:
            raise RecordTooLarge(max_record_size)
    return df.withColumn(into or column, select_column(column, text, mode, binary))
