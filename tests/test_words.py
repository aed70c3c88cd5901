import pytest

from ordinate.plans import modes
from ordinate.plans.explain import explain, ordinal
from ordinate.plans.modes import BYTES, CHARS, GRAPHEMES, LINES, UsageError
from ordinate.plans.ranges import Kind, parse_range
from ordinate.plans.translate import translate


@pytest.mark.parametrize("text, unit, want", [
    ("10:20", "line", ["10", "20 (exclusive)", "1", "lines at indices [10, 20)", "from the 11th line to the 20th line", "10"]),
    ("5:3", "line", ["5", "3 (exclusive)", "1", "lines at indices [5, 3)", "empty (start 6 is at or past end 3)", "0"]),
    ("::2", "byte", ["0", "end of input", "2", "bytes at indices [0, end of input), every 2 starting at 0", "every 2nd byte from the 1st byte to the last byte", "until end of input (step 2)"]),
    (":-2", "line", ["0", "2 from the end (exclusive)", "1", "lines at indices [0, length-2), clamped to the input length", "from the 1st line to the 3rd line from the end", "depends on the input length"]),
    ("-7:-2:3", "line", ["7 from the end", "2 from the end (exclusive)", "3", "lines at indices [length-7, length-2), every 3 starting at length-7, clamped to the input length", "every 3rd line from the 7th line from the end up to the 3rd line from the end", "at most 2"]),
    ("-2:-5", "line", ["2 from the end", "5 from the end (exclusive)", "1", "lines at indices [length-2, length-5)", "empty (start length-2 is at or past end length-5)", "0"]),
    ("18446744073709551615:", "line", ["18446744073709551615", "end of input", "1", "lines at indices [18446744073709551615, end of input)", "from the 18446744073709551615th line to the last line", "until end of input (step 1)"]),
])
def test_explain_forward(text, unit, want):
    labels = ["start: ", "end:   ", "step:  ", "0-based: ", "1-based: ", "count: "]
    assert explain(text, unit) == "".join(f"{a}{b}\n" for a, b in zip(labels, want))


@pytest.mark.parametrize("text, zero, one, count", [
    ("::-1", "lines at indices [0, length) in reverse order", "from the last line to the first line", "until end of input (reverse)"),
    (":0:-1", "lines at indices [1, length) in reverse order", "from the last line to the 2nd line", "until end of input (reverse), excluding the first line"),
    (":2:-3", "lines at indices [3, length) in reverse order, every 3 starting at the last", "every 3rd line from the last line to the 4th line", "until end of input (reverse, step 3), excluding the first 3 lines"),
    ("5:1:-1", "lines at indices 5 down to 2 (end 1 exclusive), clamped to the input length", "from the 6th line to the 3rd line", "at most 4"),
    ("5:-3:-1", "lines at indices 5 down to length-2 (end length-3 exclusive), clamped to the input length", "from the 6th line to the 4th line from the end", "depends on the input length"),
    ("-2:-5:-2", "lines at indices [length-4, length-1) in reverse order, every 2 starting at 2 from the end", "every 2nd line from the 2nd line from the end to the 6th line from the end", "at most 2"),
    ("1:5:-1", "none (start 1 is at or below end 5 for a reverse step)", "empty", "0"),
    (":-1:-1", "none (start 1 from the end is at or below end 1 from the end for a reverse step)", "empty", "0"),
    ("4:-1:-1", "none (an end 1 from the end excludes every line a reverse step can reach)", "empty", "0"),
])
def test_explain_reverse(text, zero, one, count):
    lines = explain(text).splitlines()
    assert lines[3:] == [f"0-based: {zero}", f"1-based: {one}", f"count: {count}"]


def test_explain_agrees_with_the_planner_on_emptiness():
    for s in [None, *range(-4, 5)]:
        for e in [None, *range(-4, 5)]:
            for step in (1, 2, -1, -3):
                r = parse_range(f"{'' if s is None else s}:{'' if e is None else e}:{step}")
                assert (explain(r).splitlines()[-1] == "count: 0") == (r.kind is Kind.EMPTY)


@pytest.mark.parametrize("n, want", [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"), (13, "13th"), (21, "21st"), (111, "111th"), (112, "112th"), (103, "103rd")])
def test_ordinal(n, want):
    assert ordinal(n) == want


@pytest.mark.parametrize("text, mode, dialect, want", [
    (":", GRAPHEMES, "posix", "# posix\ncat\n"),
    (":10", LINES, "gnu", "# gnu\nhead -n 10\n"),
    ("5:", LINES, "posix", "# posix\ntail -n +6\n"),
    ("5:6", LINES, "bsd", "# bsd\nsed -n '6p'\n"),
    ("5:9", LINES, "bsd", "# bsd\nsed -n '6,9p'\n"),
    ("5:9", LINES, "awk", "# awk  (awk re-terminates an unterminated final line and may drop bytes after an embedded NUL)\nawk 'NR>=6 && NR<=9'\n"),
    ("1::3", LINES, "gnu", "# gnu\nsed -n '2~3p'\n"),
    (":10", BYTES, "bsd", "# bsd  (head -c is not in POSIX; present on BSD and GNU)\nhead -c 10\n"),
    (":10", BYTES, "posix", "# posix\ndd bs=1 count=10 2>/dev/null\n"),
    ("3:5:9", BYTES, "gnu", "# gnu\ndd bs=1 skip=3 count=1 2>/dev/null\n"),
    ("3:5:1", CHARS, "gnu", "# no equivalent: cut -c is per-line (and selects bytes on GNU), not a stream character slice\n"),
    ("5:3", LINES, "gnu", "# gnu\nhead -n 0\n"),
    ("5:3", BYTES, "bsd", "# no equivalent: no POSIX single command selects an empty range; GNU has `head -c 0`\n"),
    (":-1", LINES, "posix", "# posix\nsed '$d'\n"),
    (":-2", LINES, "posix", "# no equivalent: no POSIX single command drops the last N lines; GNU has `head -n -N`\n"),
    (":-2", BYTES, "gnu", "# gnu\nhead -c -2\n"),
    ("-3:", LINES, "bsd", "# bsd\ntail -n 3\n"),
    ("-3:9", LINES, "bsd", "# no equivalent: a tail-relative start with a fixed end needs the input length\n"),
    ("::-1", LINES, "gnu", "# gnu\ntac\n"), ("::-1", LINES, "bsd", "# bsd\ntail -r\n"),
    ("::-2", LINES, "gnu", "# no equivalent: a reverse with a step needs a pipeline, not a single command\n"),
    ("::-1", BYTES, "gnu", "# no equivalent: no standard tool reverses a byte stream\n"),
    ("::2", modes.records(","), "gnu", "# no equivalent: no standard tool selects records by a custom delimiter\n"),
])
def test_translate(text, mode, dialect, want):
    assert translate(text, mode, dialect) == want


def test_translate_lists_all_dialects():
    assert translate("-3:", LINES, "all") == "# posix\ntail -n 3\n# bsd\ntail -n 3\n# gnu\ntail -n 3\n# awk  (no equivalent)\n"


@pytest.mark.parametrize("text, want", [(r"\n\r\t\0\\", b"\n\r\t\0\\"), (r"\x41\xff", b"A\xff"), ("é|", "é|".encode()), ("", b"")])
def test_unescape(text, want):
    assert modes.unescape(text) == want


@pytest.mark.parametrize("text, message", [("\\", "trailing backslash in delimiter"), (r"\q", r"unknown escape sequence `\q`"), (r"\x4", r"`\x` needs two hex digits"), (r"\xzz", r"invalid hex escape `\xzz`")])
def test_unescape_rejects(text, message):
    with pytest.raises(UsageError, match=message.replace("\\", r"\\")):
        modes.unescape(text)


def test_modes():
    assert modes.mode() == LINES
    assert modes.mode(bytes_=True) == BYTES == modes.mode(delimiter_text="")
    assert modes.mode(delimiter_text=r"\t").delimiter == rb"\t"
    assert modes.mode(delimiter_text=r"\t", escape=True).delimiter == b"\t"
    assert modes.mode(null=True).delimiter == b"\0"
    for bad in ({"chars": True, "bytes_": True}, {"null": True, "delimiter_text": ","}, {"escape": True}):
        with pytest.raises(UsageError):
            modes.mode(**bad)


@pytest.mark.parametrize("text, want", [("1", 1), ("4KB", 4000), ("4k", 4000), ("4KiB", 4096), ("1.5M", 1_500_000), ("2 GiB", 2 << 30)])
def test_sizes(text, want):
    assert modes.byte_size(text) == want


def test_size_limits():
    assert modes.record_limit("Unlimited") is None
    for bad in ("0", "x", "-1", "99999999PB"):
        with pytest.raises(UsageError):
            modes.byte_size(bad)
