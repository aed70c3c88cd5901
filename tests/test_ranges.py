import pytest

from ordinate.plans.ranges import LARGEST, Kind, Range, RangeParseError, parse_range
from ordinate.plans.translate import sql_predicate

BOUNDS = [None, *range(-20, 21)]


def text(s, e, step):
    return f"{'' if s is None else s}:{'' if e is None else e}:{step}"


def selected(r, n):
    test = sql_predicate(r).replace("greatest", "max").replace("least", "min").replace(" = ", " == ")
    code = compile(test, "predicate", "eval")
    found = [i for i in range(n) if eval(code, {"max": max, "min": min, "i": i, "n": n})]
    return found if r.step > 0 else found[::-1]


@pytest.mark.parametrize("step", [1, 2, 3, 7, -1, -2, -3, -7])
def test_every_range_selects_what_python_does(step):
    for n in (0, 1, 2, 5, 13, 24, 40):
        whole = list(range(n))
        for s in BOUNDS:
            for e in BOUNDS:
                r = parse_range(text(s, e, step))
                want = whole[s:e:step]
                assert list(r.positions(n)) == want
                assert list(r.resolve(n).positions(n)) == want
                assert r.kind is not Kind.EMPTY or want == []
                assert r.kind is not Kind.COPY or want == whole
                if n in (0, 5, 24):
                    assert selected(r, n) == want


@pytest.mark.parametrize("text, want", [
    (":", Range(0, None)), ("::", Range(0, None)), ("-0:", Range(0, None)), ("3:+4", Range(3, 7)), ("+3:5", Range(3, 5)),
    ("5:+-2", Range(3, 7)), ("1:+-5", Range(0, 6)), ("-5:+3", Range(-5, -2)), ("-5:+5", Range(-5, None)), ("-5:+-2", Range(-7, -3)),
    ("-5:+-9", Range(-14, None)), (":+4", Range(0, 4)), ("::-2", Range(-1, None, -2)), (f"{LARGEST}:+9", Range(LARGEST, LARGEST)),
])
def test_forms(text, want):
    assert parse_range(text) == want


@pytest.mark.parametrize("text, kind", [
    ("5:3", Kind.EMPTY), (":0", Kind.EMPTY), ("-3:-5", Kind.EMPTY), ("-3:0", Kind.EMPTY), ("1:5:-1", Kind.EMPTY), ("-1:-1:-1", Kind.EMPTY),
    ("5:-1:-2", Kind.EMPTY), (":", Kind.COPY), ("2:", Kind.WINDOW), ("2:9", Kind.WINDOW), ("::2", Kind.STEPPED), ("-3:", Kind.TAIL),
    ("2:-3", Kind.LAG), ("::-1", Kind.REVERSE), ("-3:5", Kind.TAIL),
])
def test_kinds(text, kind):
    assert parse_range(text).kind is kind


@pytest.mark.parametrize("text, message", [
    ("abc", "invalid start value 'abc': invalid digit found in string"),
    ("3", "range requires a ':' separator (e.g. '3:4', '3:', or ':3')"),
    ("-:", "invalid start value '-': invalid digit found in string"),
    ("--1:", "invalid start value '--1': invalid digit found in string"),
    ("1_0:", "invalid start value '1_0': invalid digit found in string"),
    (" 1:", "invalid start value ' 1': invalid digit found in string"),
    ("1:x:y", "invalid end value 'x': invalid digit found in string"),
    ("1:5:x", "invalid step value 'x': invalid digit found in string"),
    ("1:2:0", "invalid step value '0': number would be zero for non-zero type"),
    ("1:2:-0", "invalid step value '-0': number would be zero for non-zero type"),
    (f"{LARGEST + 1}:", f"invalid start value '{LARGEST + 1}': number too large to fit in target type"),
    ("1:+", "a relative end ('+' or '+-') requires a count (e.g. '5:+3' or '5:+-3')"),
    ("1:+3:-1", "a negative step cannot be combined with a relative end ('+' or '+-')"),
    ("1:2:3:4", "too many ':' separators in range (expected at most start:end:step)"),
])
def test_messages(text, message):
    with pytest.raises(RangeParseError) as e:
        parse_range(text)
    assert str(e.value) == message
