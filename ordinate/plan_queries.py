"""Registered queries of the range language and its options, which read no data, and what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ordinate.plans import modes
from ordinate.plans.explain import explain
from ordinate.plans.modes import UsageError
from ordinate.plans.ranges import RangeParseError, parse_range
from ordinate.plans.translate import translate

# Ranges by unit, and the last three lines that explain them.
EXPLAINED = [
    ("line", "10:20", "lines at indices [10, 20)", "from the 11th line to the 20th line", "10"),
    ("character", "1:3", "characters at indices [1, 3)", "from the 2nd character to the 3rd character", "2"),
    ("byte", ":5", "bytes at indices [0, 5)", "from the 1st byte to the 5th byte", "5"),
    ("grapheme", "1:3", "graphemes at indices [1, 3)", "from the 2nd grapheme to the 3rd grapheme", "2"),
    ("line", "18446744073709551615:", "lines at indices [18446744073709551615, end of input)", "from the 18446744073709551615th line to the last line", "until end of input (step 1)"),
    ("line", "-7:-2:3", "lines at indices [length-7, length-2), every 3 starting at length-7, clamped to the input length", "every 3rd line from the 7th line from the end up to the 3rd line from the end", "at most 2"),
    ("line", ":-2", "lines at indices [0, length-2), clamped to the input length", "from the 1st line to the 3rd line from the end", "depends on the input length"),
    ("line", "-5:", "lines at indices [length-5, end of input), clamped to the input length", "from the 5th line from the end to the last line", "at most 5"),
    ("line", "-2:-5", "lines at indices [length-2, length-5)", "empty (start length-2 is at or past end length-5)", "0"),
    ("line", "100:+-10", "lines at indices [90, 110)", "from the 91st line to the 110th line", "20"),
    ("line", "5:+10", "lines at indices [5, 15)", "from the 6th line to the 15th line", "10"),
    ("line", "5:1:-1", "lines at indices 5 down to 2 (end 1 exclusive), clamped to the input length", "from the 6th line to the 3rd line", "at most 4"),
    ("line", "-1:-5:-2", "lines at indices [length-4, length) in reverse order, every 2 starting at the last", "every 2nd line from the last line to the 6th line from the end", "at most 2"),
    ("byte", "::-1", "bytes at indices [0, length) in reverse order", "from the last byte to the first byte", "until end of input (reverse)"),
    ("line", "5:-3:-1", "lines at indices 5 down to length-2 (end length-3 exclusive), clamped to the input length", "from the 6th line to the 4th line from the end", "depends on the input length"),
    ("line", ":0:-1", "lines at indices [1, length) in reverse order", "from the last line to the 2nd line", "until end of input (reverse), excluding the first line"),
    ("line", "1:5:-1", "none (start 1 is at or below end 5 for a reverse step)", "empty", "0"),
    ("line", "-3:-3:-1", "none (start 3 from the end is at or below end 3 from the end for a reverse step)", "empty", "0"),
    ("line", "9:-1:-1", "none (an end 1 from the end excludes every line a reverse step can reach)", "empty", "0"),
    ("line", "-3::-1", "lines at indices [0, length-2) in reverse order", "from the 3rd line from the end to the first line", "until end of input (reverse)"),
    ("line", "::-2", "lines at indices [0, length) in reverse order, every 2 starting at the last", "every 2nd line from the last line to the first line", "until end of input (reverse, step 2)"),
    ("line", ":", "lines at indices [0, end of input)", "from the 1st line to the last line", "until end of input (step 1)"),
    ("line", "::2", "lines at indices [0, end of input), every 2 starting at 0", "every 2nd line from the 1st line to the last line", "until end of input (step 2)"),
]

# Units, dialects and ranges, and the commands nearest to them.
TRANSLATED = [
    ("line", "awk", "1:5", "# awk  (awk re-terminates an unterminated final line and may drop bytes after an embedded NUL)\nawk 'NR>=2 && NR<=5'\n"),
    ("byte", "bsd", ":5", "# bsd  (head -c is not in POSIX; present on BSD and GNU)\nhead -c 5\n"),
    ("byte", "posix", "5:6:2", "# posix\ndd bs=1 skip=5 count=1 2>/dev/null\n"),
    ("byte", "posix", "5:15", "# posix\ndd bs=1 skip=5 count=10 2>/dev/null\n"),
    ("character", "all", ":", "# posix\ncat\n# bsd\ncat\n# gnu\ncat\n# awk\ncat\n"),
    ("line", "posix", "5:3", "# no equivalent: no POSIX single command selects an empty range; GNU has `head -n 0`\n"),
    ("byte", "gnu", "5:3", "# gnu\nhead -c 0\n"),
    ("line", "gnu", "::2", "# gnu\nsed -n '1~2p'\n"),
    ("line", "posix", "::2", "# posix  (awk re-terminates an unterminated final line and may drop bytes after an embedded NUL)\nawk 'NR%2==1'\n"),
    ("grapheme", "gnu", "1:5", "# no equivalent: no standard tool selects by grapheme cluster\n"),
    ("line", "posix", ":5", "# posix\nhead -n 5\n"),
    ("line", "posix", "1:5", "# posix\nsed -n '2,5p'\n"),
    ("line", "all", "::-1", "# posix  (no equivalent)\n# bsd\ntail -r\n# gnu\ntac\n# awk  (no equivalent)\n"),
    ("byte", "gnu", "::-1", "# no equivalent: no standard tool reverses a byte stream\n"),
    ("part", "gnu", "::-1", "# no equivalent: no standard tool selects records by a custom delimiter\n"),
    ("line", "gnu", "5:1:-1", "# no equivalent: reversing a sub-range needs a pipeline, not a single command\n"),
    ("line", "posix", "::-1", "# no equivalent: no POSIX single command reverses line order; GNU has tac, BSD has tail -r\n"),
    ("line", "gnu", "::-2", "# no equivalent: a reverse with a step needs a pipeline, not a single command\n"),
]

# Texts that are no range, and why.
REFUSED = [
    ("3", "range requires a ':' separator (e.g. '3:4', '3:', or ':3')"),
    ("abc", "invalid start value 'abc': invalid digit found in string"),
    ("-:", "invalid start value '-': invalid digit found in string"),
    ("1_0:", "invalid start value '1_0': invalid digit found in string"),
    (" 1:", "invalid start value ' 1': invalid digit found in string"),
    ("1:x", "invalid end value 'x': invalid digit found in string"),
    ("1:2:x", "invalid step value 'x': invalid digit found in string"),
    ("1:2:0", "invalid step value '0': number would be zero for non-zero type"),
    ("1:2:-0", "invalid step value '-0': number would be zero for non-zero type"),
    ("1:2:3:4", "too many ':' separators in range (expected at most start:end:step)"),
    ("5:+", "a relative end ('+' or '+-') requires a count (e.g. '5:+3' or '5:+-3')"),
    ("5:+-", "a relative end ('+' or '+-') requires a count (e.g. '5:+3' or '5:+-3')"),
    ("5:+3:-1", "a negative step cannot be combined with a relative end ('+' or '+-')"),
    ("18446744073709551616:", "invalid start value '18446744073709551616': number too large to fit in target type"),
]

# Sizes in bytes.
SIZES = [("1", 1), ("4KB", 4000), ("4k", 4000), ("4KiB", 4096), ("1.5M", 1_500_000), ("2 GiB", 2_147_483_648), ("7b", 7), ("1MiB", 1_048_576)]

# Delimiter options (text, escapes, NUL) and the delimiter's bytes in hex, empty for bytes, or nothing if refused.
DELIMITERS = [
    (",", False, False, "2C"), (r"\t", False, False, "5C74"), (r"\t", True, False, "09"), (r"\x41\xff", True, False, "41FF"), (r"\n\r\0\\", True, False, "0A0D005C"),
    ("é|", False, False, "C3A97C"), ("", False, False, ""), (None, False, True, "00"), (None, False, False, "0A"), (None, True, False, None),
    (",", False, True, None), ("\\", True, False, None), (r"\q", True, False, None), (r"\x4", True, False, None), (r"\xzz", True, False, None),
]

UNITS = {"line": modes.LINES, "byte": modes.BYTES, "character": modes.CHARS, "grapheme": modes.GRAPHEMES, "part": modes.records(",")}


def refusal(text: str) -> str | None:
    try:
        parse_range(text)
    except RangeParseError as e:
        return str(e)


def delimiter(text: str | None, escape: bool, null: bool) -> str | None:
    try:
        return modes.mode(delimiter_text=text, escape=escape, null=null).delimiter.hex().upper()
    except UsageError:
        return None


def literal(value) -> str:
    if value is None:
        return "null"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower()


def values(rows: list[tuple], columns: str, casts: str) -> str:
    rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"select {casts} from (values {rows}) as t({columns})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ranges_explained": lambda spark, _: spark.createDataFrame([(unit, text, *(line.partition(": ")[2] for line in explain(text, unit).splitlines()[3:])) for unit, text, *_ in EXPLAINED], "unit string, range string, zero string, one string, n string"),
    "ranges_translated": lambda spark, _: spark.createDataFrame([(unit, dialect, text, translate(text, UNITS[unit], dialect)) for unit, dialect, text, _ in TRANSLATED], "unit string, dialect string, range string, command string"),
    "ranges_refused": lambda spark, _: spark.createDataFrame([(text, refusal(text)) for text, _ in REFUSED], "range string, why string"),
    "sizes_read": lambda spark, _: spark.createDataFrame([(text, modes.byte_size(text)) for text, _ in SIZES], "size string, n bigint"),
    "delimiters_read": lambda spark, _: spark.createDataFrame([(*d[:3], delimiter(*d[:3])) for d in DELIMITERS], "given string, escapes boolean, nul boolean, bytes string"),
}

ORACLES = {
    "ranges_explained": values(EXPLAINED, "unit, range, zero, one, n", "unit, range, zero, one, n"),
    "ranges_translated": values(TRANSLATED, "unit, dialect, range, command", "unit, dialect, range, command"),
    "ranges_refused": values(REFUSED, "range, why", "range, why"),
    "sizes_read": values(SIZES, "size, n", "size, n::bigint as n"),
    "delimiters_read": values(DELIMITERS, "given, escapes, nul, bytes", "given, escapes::boolean as escapes, nul::boolean as nul, bytes"),
}
