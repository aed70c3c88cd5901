import regex
import pytest

from ordinate.functions.selecting import RecordTooLarge, elements, select_column, select_texts
from ordinate.plans.modes import BYTES, CHARS, GRAPHEMES, LINES, records
from ordinate.plans.ranges import parse_range

RANGES = ["5:3", ":", ":2", "1:", "1:3", "::2", "1:9:3", "-2:", "-3:-1", "-5::2", "-3:2", "1:-1", ":-1:2", "::-1", "::-2", "3:0:-1", "-2:0:-2", "1:-3:-1", "-99:", "99:", "99::-1"]
TEXTS = ["", "a", "a\n", "\n", "a\nb\nc", "a\nb\nc\n", "\na\n\nb\n", "a\r\nb\r\nc", "héé\nあ\U0001F600x\n", "a,b,c", ",a,,b,", "a||b|||c||", "aaaaaa", "q\\Ex.y\\Ez", None]
BINARIES = [b"", b"abc", b"\xff\xe3\x81\x82\x80", b"\xc0\x80a", b"\xed\xa0\x80", b"\xf0\x90A", "é\nあ\n".encode(), b"a\0b\0c\0", bytes(range(256)), b"a\xff\nb\n\xe3\x81", None]


def chunks(data, by):
    parts = data.split(by)
    return [p + by for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def model(data, text, mode):
    """The selected elements of bytes, concatenated; backwards the last record's missing delimiter moves to the end."""
    if mode is BYTES:
        items = [data[i:i + 1] for i in range(len(data))]
    elif mode is CHARS:
        items = [c.encode("utf-8", "surrogateescape") for c in data.decode("utf-8", "surrogateescape")]
    elif mode is GRAPHEMES:
        items = [c.encode("utf-8", "surrogateescape") for c in regex.findall(r"\X", data.decode("utf-8", "surrogateescape"))]
    else:
        items = chunks(data, mode.delimiter)
    r = parse_range(text)
    chosen = r.positions(len(items))
    out = [items[i] for i in chosen]
    if mode.delimited and r.step < 0 and out and chosen[0] == len(items) - 1 and not out[0].endswith(mode.delimiter):
        out = [out[0] + mode.delimiter, *out[1:]]
        out[-1] = out[-1].removesuffix(mode.delimiter)
    return b"".join(out)


MODES = [LINES, BYTES, CHARS, GRAPHEMES, records(","), records("||"), records("aaa"), records(r"\E"), records(".")]


@pytest.mark.parametrize("mode", MODES, ids=lambda m: f"{m.unit.name}-{m.delimiter!r}")
def test_strings(spark, mode):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    got = df.select("k", *(select_column("t", r, mode).alias(f"r{j}") for j, r in enumerate(RANGES))).collect()
    for row in got:
        for j, r in enumerate(RANGES):
            t = TEXTS[row.k]
            value = row[f"r{j}"]
            value = value.encode() if isinstance(value, str) else value
            assert (None if value is None else bytes(value)) == (None if t is None else model(t.encode(), r, mode)), (t, r)


@pytest.mark.parametrize("mode", [LINES, BYTES, CHARS, GRAPHEMES, records(b"\0"), records(b"\xff"), records(b"\x81")], ids=lambda m: f"{m.unit.name}-{m.delimiter!r}")
def test_binaries(spark, mode):
    df = spark.createDataFrame([(k, None if t is None else bytearray(t)) for k, t in enumerate(BINARIES)], "k int, t binary")
    got = df.select("k", *(select_column("t", r, mode, binary=True).alias(f"r{j}") for j, r in enumerate(RANGES))).collect()
    for row in got:
        for j, r in enumerate(RANGES):
            t = BINARIES[row.k]
            value = row[f"r{j}"]
            assert (None if value is None else bytes(value)) == (None if t is None else model(t, r, mode)), (t, r)


def test_elements(spark):
    df = spark.createDataFrame([("a\n\nb",), ("",)], "t string")
    assert [r[0] for r in df.select(elements("t")).collect()] == [["a\n", "\n", "b"], []]
    assert [r[0] for r in df.select(elements("t", CHARS)).collect()] == [["a", "\n", "\n", "b"], []]
    assert [bytes(x) for x in df.select(elements("t", BYTES)).first()[0]] == [b"a", b"\n", b"\n", b"b"]


def test_grapheme_clusters(spark):
    texts = ["a\U0001F468‍\U0001F469‍\U0001F467b", "ab\r\n", "क्षि", "éx", "\U0001F1EB\U0001F1F7\U0001F1E9\U0001F1EA"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(elements("t", GRAPHEMES)).collect()] == [
        ["a", texts[0][1:-1], "b"], ["a", "b", "\r\n"], ["क्षि"], ["é", "x"], [texts[4][:2], texts[4][2:]]]


@pytest.mark.parametrize("text, mode, limit, fails", [
    ("-2:", LINES, 7, True), ("-2:", LINES, 8, False), ("::-1", LINES, 7, True), ("-3:0", LINES, 1, False), ("-9:2", LINES, 7, False), ("-9:3", LINES, 7, True),
    ("0:-1", LINES, 7, True), ("3:-1", LINES, 7, False), (":-1:2", LINES, 7, True), ("1:-1:2", LINES, 7, False), (":2", LINES, 1, False), ("::-1", BYTES, 1, False), ("::-1", CHARS, 1, False),
])
def test_record_limit(spark, text, mode, limit, fails):
    df = spark.createDataFrame([("ab\ncd\ntoolong\nef\n",)], "t string")
    if fails:
        with pytest.raises(RecordTooLarge, match=f"max-record-size={limit} bytes"):
            select_texts(df, "t", text, mode, max_record_size=limit)
    else:
        assert select_texts(df, "t", text, mode, max_record_size=limit).count() == 1


def test_clusters_are_cut_by_few_values_at_a_time(spark):
    """Batches of Arrow hold as many rows whatever their size; all of one would be in a worker's memory at once."""
    df = spark.createDataFrame([("éa",)], "t string")
    for column in (select_column("t", "-100::9", GRAPHEMES), elements("t", GRAPHEMES)):
        plan = df.select(column.alias("t"))._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
