"""What an element is: a line, byte, code point, grapheme cluster, or a record that a delimiter ends."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum


class UsageError(ValueError):
    """Options that do not go together, or a value that is not one."""


class Unit(Enum):
    LINES = "line"
    BYTES = "byte"
    CHARS = "character"
    GRAPHEMES = "grapheme"
    CUSTOM = "part"


@dataclass(frozen=True)
class Mode:
    unit: Unit = Unit.LINES
    delimiter: bytes = b"\n"

    @property
    def delimited(self) -> bool:
        return self.unit in (Unit.LINES, Unit.CUSTOM)


LINES = Mode()
BYTES = Mode(Unit.BYTES, b"")
CHARS = Mode(Unit.CHARS, b"")
GRAPHEMES = Mode(Unit.GRAPHEMES, b"")

_PLAIN_ESCAPES = {"n": b"\n", "r": b"\r", "t": b"\t", "0": b"\0", "\\": b"\\"}


def unescape(text: str) -> bytes:
    r"""The bytes of a delimiter written with ``\n \r \t \0 \\ \xHH``; all else stands for itself."""
    def value(m: re.Match) -> bytes:
        escape = m.group(1).decode("utf-8", "replace")
        if not escape:
            raise UsageError("trailing backslash in delimiter")
        if escape in _PLAIN_ESCAPES:
            return _PLAIN_ESCAPES[escape]
        if escape[0] != "x":
            raise UsageError(f"unknown escape sequence `\\{escape[0]}`")
        if len(m.group(1)) < 3:
            raise UsageError("`\\x` needs two hex digits")
        if not re.fullmatch("[0-9a-fA-F]{2}", escape[1:]):
            raise UsageError(f"invalid hex escape `\\{escape}`")
        return bytes([int(escape[1:], 16)])

    return re.sub(rb"(?s)\\(x.{0,2}|.?)", value, text.encode())


def delimiter(text: str | None = None, escape: bool = False, null: bool = False) -> bytes | None:
    """The bytes that options name; None for lines."""
    if escape and text is None:
        raise UsageError("escape requires a delimiter")
    if null:
        return b"\0"
    if text is None:
        return None
    return unescape(text) if escape else text.encode()


def mode(lines: bool = False, bytes_: bool = False, chars: bool = False, graphemes: bool = False, delimiter_text: str | None = None, escape: bool = False, null: bool = False) -> Mode:
    """The mode that options name: at most one of them, lines if none. An empty delimiter means bytes."""
    if sum((lines, bytes_, chars, graphemes, delimiter_text is not None, null)) > 1:
        raise UsageError("the modes exclude each other")
    by = delimiter(delimiter_text, escape, null)
    if by is not None:
        return records(by)
    return BYTES if bytes_ else CHARS if chars else GRAPHEMES if graphemes else LINES


def records(by: bytes | str) -> Mode:
    by = by.encode() if isinstance(by, str) else by
    return Mode(Unit.CUSTOM, by) if by else BYTES


# Units of sizes, decimal and binary.
SIZES = {"": 1, "b": 1} | {f"{c}{tail}": base ** k for k, c in enumerate("kmgtpe", 1) for tail, base in (("", 1000), ("b", 1000), ("i", 1024), ("ib", 1024))}


def byte_size(text: str) -> int:
    """``4KB`` is 4000, ``4KiB`` 4096; not zero."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text, re.ASCII)
    if not m or m.group(2).lower() not in SIZES:
        raise UsageError(f"'{text}' is not a size")
    size = int(float(m.group(1)) * SIZES[m.group(2).lower()]) if "." in m.group(1) else int(m.group(1)) * SIZES[m.group(2).lower()]
    if size == 0:
        raise UsageError("0 is not allowed")
    if size >= 1 << 64:
        raise UsageError("size is too large for this platform")
    return size


def record_limit(text: str) -> int | None:
    """A size, or None for ``unlimited``."""
    return None if text.lower() == "unlimited" else byte_size(text)
