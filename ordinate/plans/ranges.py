"""The range language and its planner. Nothing here touches Spark or reads data.

A range is ``start:end[:step]`` with Python's meaning. Bounds are signed integers here: a negative one counts from
the end, and no bound can be "zero from the end", since ``-0`` is ``0``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

#: Indices are unsigned 64-bit numbers in the language; arithmetic on them saturates.
LARGEST = (1 << 64) - 1


class RangeParseError(ValueError):
    """A range text that is not one; the message says which part."""


# The messages of the language.
NO_COLON = "range requires a ':' separator (e.g. '3:4', '3:', or ':3')"
NO_COUNT = "a relative end ('+' or '+-') requires a count (e.g. '5:+3' or '5:+-3')"
REVERSE_RELATIVE = "a negative step cannot be combined with a relative end ('+' or '+-')"
TOO_MANY_PARTS = "too many ':' separators in range (expected at most start:end:step)"
NOT_A_NUMBER = "invalid digit found in string"
TOO_LARGE = "number too large to fit in target type"
ZERO = "number would be zero for non-zero type"

_DIGITS = re.compile(r"\+?[0-9]+", re.ASCII)
_FROM_END = re.compile(r"-[0-9]", re.ASCII)


def _number(text: str, field: str, whole: str) -> int:
    if not _DIGITS.fullmatch(text):
        raise RangeParseError(f"invalid {field} value '{whole}': {NOT_A_NUMBER}")
    if (value := int(text)) > LARGEST:
        raise RangeParseError(f"invalid {field} value '{whole}': {TOO_LARGE}")
    return value


def _signed(text: str, field: str) -> int | None:
    """A bound or step, None if left out. A minus sign counts only right before a digit."""
    if not text:
        return None
    if _FROM_END.match(text):
        return -_number(text[1:], field, text)
    return _number(text, field, text)


class Kind(Enum):
    EMPTY = "empty"
    COPY = "copy"
    WINDOW = "window"
    STEPPED = "stepped"
    TAIL = "tail"
    LAG = "lag"
    REVERSE = "reverse"


@dataclass(frozen=True)
class Range:
    start: int
    end: int | None
    step: int = 1

    @property
    def kind(self) -> Kind:
        """What the range asks for, as far as that does not depend on the number of elements."""
        start, end, step = self.start, self.end, self.step
        same_side = end is not None and (start < 0) == (end < 0)
        if step < 0:
            return Kind.EMPTY if end == -1 or same_side and start <= end else Kind.REVERSE
        if end == 0 or same_side and start >= end:
            return Kind.EMPTY
        if start < 0:
            return Kind.TAIL
        if end is not None and end < 0:
            return Kind.LAG
        if step > 1:
            return Kind.STEPPED
        return Kind.COPY if start == 0 and end is None else Kind.WINDOW

    def positions(self, n: int) -> range:
        """Of n elements, the selected positions in output order."""
        return range(*slice(self.start, self.end, self.step).indices(n))

    def resolve(self, n: int) -> Range:
        """The range over n elements, with bounds from the start where that is possible: an end at or past n is left out."""
        if self.step < 0:
            found = self.positions(n)
            return Range(found[0], found[-1] - 1 if found[-1] else None, self.step) if found else Range(0, 0)
        low, high, _ = slice(self.start, self.end).indices(n)
        return Range(low, high if high < n else None, self.step)

    def __str__(self) -> str:
        return f"{self.start}:{'' if self.end is None else self.end}:{self.step}"


def parse_range(text: str) -> Range:
    """The range of a text, its parts checked from left to right.

    An end ``+n`` is n elements from the start on; ``+-n`` n elements to either side of the start.
    """
    parts = text.split(":")
    start = _signed(parts[0], "start")
    if len(parts) == 1:
        raise RangeParseError(NO_COLON)
    relative = next((sign for sign in ("+-", "+") if parts[1].startswith(sign)), None)
    if relative:
        amount = parts[1].removeprefix(relative)
        if not amount:
            raise RangeParseError(NO_COUNT)
        end = _number(amount, "end", amount)
    else:
        end = _signed(parts[1], "end")
    step = _signed(parts[2], "step") if len(parts) > 2 else None
    if step == 0:
        raise RangeParseError(f"invalid step value '{parts[2]}': {ZERO}")
    if len(parts) > 3:
        raise RangeParseError(TOO_MANY_PARTS)
    step = 1 if step is None else step
    if start is None:
        start = -1 if step < 0 else 0
    if not relative:
        return Range(start, end, step)
    if step < 0:
        raise RangeParseError(REVERSE_RELATIVE)
    n = end
    end = min(start + n, LARGEST) if start >= 0 else start + n
    if start < 0 <= end:
        end = None  # it reaches the end of the input
    if relative == "+-":
        start = max(start - n, 0 if start >= 0 else -LARGEST)
    return Range(start, end, step)


def as_range(r: Range | str) -> Range:
    return parse_range(r) if isinstance(r, str) else r
