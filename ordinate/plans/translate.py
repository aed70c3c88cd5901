"""The nearest shell command for a range, and a Spark SQL predicate for it; no input is read."""

from __future__ import annotations

import platform
import sys

from ordinate.plans.modes import LINES, Mode, Unit
from ordinate.plans.ranges import LARGEST, Kind, Range, as_range

DIALECTS = ("posix", "bsd", "gnu", "awk")

# Notes and reasons of the output.
NOTES = {
    "awk": "awk re-terminates an unterminated final line and may drop bytes after an embedded NUL",
    "head -c": "head -c is not in POSIX; present on BSD and GNU",
}
REASONS = {
    Unit.CUSTOM: "no standard tool selects records by a custom delimiter",
    Unit.CHARS: "cut -c is per-line (and selects bytes on GNU), not a stream character slice",
    Unit.GRAPHEMES: "no standard tool selects by grapheme cluster",
    "byte step": "strided byte selection has no standard-tool equivalent",
    "byte awk": "awk operates on lines, not byte offsets",
    "awk tail": "selecting relative to the end needs buffering, not a clean awk one-liner",
    "lag start": "a head-relative start with a tail-relative end needs the input length",
    "lag step": "a tail-relative end combined with a step has no standard-tool equivalent",
    "drop last": "no POSIX single command drops the last N {unit}s; GNU has `head -{flag} -N`",
    "empty": "no POSIX single command selects an empty range; GNU has `head -{flag} 0`",
    "tail step": "a tail-relative start combined with a step has no standard-tool equivalent",
    "tail end": "a tail-relative start with a fixed end needs the input length",
    "reverse posix": "no POSIX single command reverses line order; GNU has tac, BSD has tail -r",
    "reverse part": "reversing a sub-range needs a pipeline, not a single command",
    "reverse step": "a reverse with a step needs a pipeline, not a single command",
    "reverse bytes": "no standard tool reverses a byte stream",
}


class NoEquivalent(Exception):
    def __init__(self, reason, **words):
        super().__init__(REASONS[reason].format(**words))


def default_dialect() -> str:
    """gnu on Linux with glibc, bsd on the BSDs and macOS, else posix."""
    if sys.platform.startswith("linux"):
        return "gnu" if platform.libc_ver()[0] == "glibc" else "posix"
    return "bsd" if "bsd" in sys.platform or sys.platform in ("darwin", "dragonfly") else "posix"


def translate(text: Range | str, mode: Mode = LINES, dialect: str | None = None) -> str:
    """``# dialect  (note)`` and the command, or ``# no equivalent: reason``; one block a dialect for ``all``."""
    r, dialect = as_range(text), dialect or default_dialect()
    if dialect not in (*DIALECTS, "all"):
        raise ValueError(f"unknown dialect: {dialect}")
    out = []
    for d in DIALECTS if dialect == "all" else (dialect,):
        try:
            command = _command(r, mode.unit, d)
        except NoEquivalent as e:
            out.append(f"# {d}  (no equivalent)\n" if dialect == "all" else f"# no equivalent: {e}\n")
            continue
        note = NOTES["awk"] if command.startswith("awk ") else NOTES["head -c"] if command.startswith("head -c ") and r.kind is Kind.WINDOW or command.startswith("head -c ") and r.kind is Kind.STEPPED else None
        out.append(f"# {d}{f'  ({note})' if note else ''}\n{command}\n")
    return "".join(out)


def _command(r: Range, unit: Unit, dialect: str) -> str:
    kind = r.kind
    if kind is Kind.COPY:
        return "cat"
    if unit not in (Unit.LINES, Unit.BYTES):
        raise NoEquivalent(unit)
    flag = "n" if unit is Unit.LINES else "c"
    make = {Kind.EMPTY: _empty, Kind.LAG: _lag, Kind.TAIL: _tail, Kind.REVERSE: _reverse}.get(kind, _from_start)
    return make(r, unit, flag, dialect)


def _empty(r: Range, unit: Unit, flag: str, dialect: str) -> str:
    if dialect != "gnu":
        raise NoEquivalent("empty", flag=flag)
    return f"head -{flag} 0"


def _from_start(r: Range, unit: Unit, flag: str, dialect: str) -> str:
    start, end, step = r.start, r.end, r.step
    first = min(start + 1, LARGEST)
    if unit is Unit.BYTES:
        if step > 1:
            if end is None or end - start > step:
                raise NoEquivalent("byte step")
            end = first  # the stride reaches one byte only
        if dialect == "awk":
            raise NoEquivalent("byte awk")
        if end is None:
            return f"tail -c +{first}"
        if start == 0 and dialect != "posix":
            return f"head -c {end}"
        return f"dd bs=1 {f'skip={start} ' if start else ''}count={end - start} 2>/dev/null"
    if step > 1 and end is None and dialect == "gnu":
        return f"sed -n '{first}~{step}p'"
    if step > 1 or dialect == "awk":
        tests = []
        if step > 1:
            tests += [f"NR%{step}==1"] if first == 1 else [f"NR>={first}", f"(NR-{first})%{step}==0"]
        elif first > 1 or end is None:
            tests.append(f"NR>={first}")
        if end is not None:
            tests.append(f"NR<={end}")
        return f"awk '{' && '.join(tests)}'"
    if end is None:
        return f"tail -n +{first}"
    if start == 0:
        return f"head -n {end}"
    return f"sed -n '{first}p'" if end == first else f"sed -n '{first},{end}p'"


def _lag(r: Range, unit: Unit, flag: str, dialect: str) -> str:
    if r.start > 0:
        raise NoEquivalent("lag start")
    if r.step > 1:
        raise NoEquivalent("lag step")
    if dialect == "awk":
        raise NoEquivalent("awk tail" if unit is Unit.LINES else "byte awk")
    if dialect == "gnu":
        return f"head -{flag} {r.end}"
    if unit is Unit.LINES and r.end == -1:
        return "sed '$d'"
    raise NoEquivalent("drop last", unit=unit.value, flag=flag)


def _tail(r: Range, unit: Unit, flag: str, dialect: str) -> str:
    if r.step > 1:
        raise NoEquivalent("tail step")
    if r.end is not None:
        raise NoEquivalent("tail end")
    if dialect == "awk":
        raise NoEquivalent("awk tail" if unit is Unit.LINES else "byte awk")
    return f"tail -{flag} {-r.start}"


def _reverse(r: Range, unit: Unit, flag: str, dialect: str) -> str:
    if unit is Unit.BYTES:
        raise NoEquivalent("reverse bytes")
    if (r.start, r.end) != (-1, None):
        raise NoEquivalent("reverse part")
    if r.step < -1:
        raise NoEquivalent("reverse step")
    if dialect == "gnu":
        return "tac"
    if dialect == "bsd":
        return "tail -r"
    raise NoEquivalent("reverse posix" if dialect == "posix" else "awk tail")


def sql_bounds(r: Range, n: str = "n") -> tuple[str, str]:
    """SQL for the lowest selected position and the one past the highest, over n elements. For a reverse range the walk starts right below the second."""
    def clamp(v: int) -> str:
        return f"greatest({n} - {-v}, 0)" if v < 0 else f"least({min(v, (1 << 63) - 1)}, {n})"

    if r.step > 0:
        return clamp(r.start), n if r.end is None else clamp(r.end)
    lowest = "0" if r.end is None else clamp(r.end + 1) if r.end != -1 else n
    return lowest, clamp(r.start + 1) if r.start != -1 else n


def sql_predicate(text: Range | str, i: str = "i", n: str = "n") -> str:
    """A SQL test of a 0-based position, in Spark and in ANSI SQL."""
    r = as_range(text)
    if r.kind is Kind.EMPTY:
        return "1 = 0"
    low, high = sql_bounds(r, n)
    test = f"{i} >= {low} and {i} < {high}"
    if abs(r.step) > 1:
        step = min(abs(r.step), (1 << 63) - 1)
        test += f" and ({i} - {low}) % {step} = 0" if r.step > 0 else f" and ({high} - 1 - {i}) % {step} = 0"
    return test
