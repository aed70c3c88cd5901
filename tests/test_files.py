import itertools

import pytest

from ordinate.functions.selecting import RecordTooLarge
from ordinate.plans.modes import BYTES, CHARS, GRAPHEMES, LINES, records
from ordinate.plans.ranges import parse_range
from ordinate.sources import files, ranges
from ordinate.sources.ranges import byte_ranges
from tests.test_selecting import RANGES, model

FIXTURES = {
    "five": "".join(f"line{k}\n" for k in range(5)).encode(),
    "open": b"alpha\nbeta\ngamma",
    "crlf": b"a\r\nb\r\nc",
    "blank": b"a\n\n\nb\n",
    "letters": b"abcdefghijklmnopqrstuvwxyz\n",
    "accent": b"caf\xc3\xa9\n",
    "invalid": b"\xff\xe3\x81\x82\x80",
    "nul": b"a\0b\0c\0",
    "commas": b",a,,b,",
    "none": b"",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, data in FIXTURES.items():
        (path / name).write_bytes(data)
    return path


@pytest.mark.parametrize("mode", [LINES, BYTES, CHARS, GRAPHEMES, records(b"\0"), records(",")], ids=lambda m: f"{m.unit.name}-{m.delimiter!r}")
@pytest.mark.parametrize("text", RANGES[::2])
def test_all_files(spark, folder, text, mode):
    paths = [str(folder / n) for n in FIXTURES]
    got = files.output(files.select_files(spark, paths, text, mode))
    assert got == b"".join(f"==> {folder / n} <==\n".encode() + model(d, text, mode) for n, d in FIXTURES.items())


def test_headers(spark, folder):
    a, b = str(folder / "open"), str(folder / "five")
    assert files.output(files.select_files(spark, [a], ":1")) == b"alpha\n"
    assert files.output(files.select_files(spark, [b, a, b], "-1:", quiet=True)) == b"line4\ngammaline4\n"
    assert files.output(files.select_files(spark, [a, b], "-1:")) == f"==> {a} <==\ngamma==> {b} <==\nline4\n".encode()
    assert files.output(files.select_files(spark, [a, b], "3:1")) == f"==> {a} <==\n==> {b} <==\n".encode()
    assert {bytes(r.content) for r in files.concatenated(files.select_files(spark, [a, b], ":1")).collect()} == {f"==> {a} <==\nalpha\n".encode(), f"==> {b} <==\nline0\n".encode()}


@pytest.mark.parametrize("text", [":1", "3:1"])
def test_a_missing_file_does_not_stop_the_others(spark, folder, text):
    a, b, c = str(folder / "open"), str(folder / "absent"), str(folder / "five")
    with pytest.raises(files.SourceError, match="absent: No such file") as e:
        files.select_files(spark, [a, b, c], text)
    want = [f"==> {p} <==\n".encode() + model(FIXTURES[n], text, LINES) for p, n in ((a, "open"), (c, "five"))]
    assert files.output(e.value.result) == b"".join(want)
    assert files.output(files.select_files(spark, [a, b, c], text, strict=False)) == b"".join(want)


def test_byte_pieces(spark, folder):
    path = f"file:{folder / 'letters'}"
    got = byte_ranges(spark, [(0, "x", path, 3, 11, 1), (1, "y", path, 26, 0, 1)], piece=4).collect()
    assert [(r.file_no, r.i, bytes(r.content)) for r in sorted(got, key=lambda r: (r.file_no, r.i))] == [(0, 0, b"defg"), (0, 4, b"hijk"), (0, 8, b"lmn"), (1, 0, b"")]


def test_record_limit(spark, folder):
    with pytest.raises(RecordTooLarge):
        files.select_files(spark, [str(folder / "five")], "-2:", max_record_size=5)
    assert files.output(files.select_files(spark, [str(folder / "five")], "-2:", max_record_size=6)) == b"line3\nline4\n"


def test_large_files_by_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        data = {"a": b"".join(b"row %d\n" % k for k in range(200)), "b": b"".join(b"x%d\n" % k for k in range(90)) + b"end", "c": b""}
        for n, d in data.items():
            (tmp_path / n).write_bytes(d)
        paths = [str(tmp_path / n) for n in data]
        read = files.read_records(spark, paths)
        assert read.rdd.getNumPartitions() > 3
        rows = sorted((r.file_no, r.i, bytes(r.elem), r.terminated, r.n) for r in read.collect())
        assert [r[2] for r in rows if r[0] == 0] == data["a"].split(b"\n")[:-1]
        assert [r[1] for r in rows] == [*range(200), *range(91)]
        assert [r[3] for r in rows] == [True] * 290 + [False] and {r[4] for r in rows} == {200, 91}
        for text in ("5:9", "-4:", "::50", "-60::7", "3:-85", "::-1", "::-40", "-2::-30", "60:10:-25", "4:2"):
            got = sorted((r.file_no, r.pos, bytes(r.elem)) for r in files.select_records(spark, paths, text).collect())
            for no, n in enumerate(data):
                assert b"".join(e for f, _, e in got if f == no) == model(data[n], text, LINES), (text, n)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("mode", [BYTES, CHARS, GRAPHEMES, LINES, records(","), records("||")], ids=lambda m: f"{m.unit.name}-{m.delimiter!r}")
@pytest.mark.parametrize("text", ["3:21:4", "-9:-2", "2:-3:2", "::-1", "-2:1:-5"])
def test_large_files_as_small_ones(spark, tmp_path, mode, text, monkeypatch):
    """Pieces of a few bytes, cut within code points, clusters and malformed bytes."""
    monkeypatch.setattr(ranges, "PIECE", 5)
    data = {"mixed": "é\u0301中\r\na\U0001F468\u200d\U0001F469,\n\n\U0001F1E9\U0001F1EA\U0001F1EB,,b||c|||d".encode() + b"\xff\xe3\x81\xe3\x81\x82\x80\xed\xa0\x80\xf0\x9f\x98", "ascii": b"abcdefg,hij\nklm,n", "none": b""}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    got = files.output(files.select_files(spark, [str(tmp_path / n) for n in data], text, mode, quiet=True, large=0))
    assert got == b"".join(model(d, text, mode) for d in data.values())


def test_delimiters_that_split(spark, folder):
    assert [files.splits(d) for d in (b"\n", b"ab", b"||", b"aba", b"\xff")] == [True, True, False, False, False]
    with pytest.raises(ValueError, match="overlap itself"):
        files.read_records(spark, [str(folder / "five")], records("||"))


def test_long_delimiters_across_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "53")
    try:
        data = b"".join(b"row %d<ab>" % k for k in range(120)) + b"end<a"
        (tmp_path / "x").write_bytes(data)
        for text in ("::7", "-30:-3", "-1::-11"):
            rows = sorted((r.pos, bytes(r.elem)) for r in files.select_records(spark, [str(tmp_path / "x")], text, records("<ab>")).collect())
            assert b"".join(e for _, e in rows) == model(data, text, records("<ab>")), text
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text, most", [("-2:", 8), (":1", None), ("-9:2", 3), ("1:-1:2", 7), ("::-1", 8), ("0::2", None)])
def test_record_limit_of_large_files(spark, tmp_path, text, most):
    """The largest record that the limit applies to is `most` bytes; None where it applies to none."""
    (tmp_path / "x").write_bytes(b"a\nbb\ncc\nlarger\n1234567\n3333\n".replace(b"cc", b"c"))
    (tmp_path / "y").write_bytes("ae\u0301\u0301\U0001F468\u200d\U0001F469b".encode())
    for path, mode, size in (("x", LINES, most), ("y", GRAPHEMES, None if most is None else {"-2:": 11, "-9:2": 5, "1:-1:2": 5, "::-1": 11}[text])):
        for limit in (1000,) if size is None else (size, size - 1):
            def out(large):
                return files.output(files.select_files(spark, [str(tmp_path / path)], text, mode, max_record_size=limit, large=large))
            if size is not None and limit < size:
                for large in (0, 1000):
                    with pytest.raises(RecordTooLarge):
                        out(large)
            else:
                assert out(0) == out(1000)


@pytest.mark.parametrize("mode", [BYTES, CHARS], ids=lambda m: m.unit.name)
def test_files_that_python_cannot_open_are_values(spark, folder, mode, monkeypatch):
    monkeypatch.setattr(files, "seekable", lambda path: False)
    paths = [str(folder / n) for n in FIXTURES]
    assert files.output(files.select_files(spark, paths, "1:-1:3", mode, quiet=True, large=0)) == b"".join(model(d, "1:-1:3", mode) for d in FIXTURES.values())
    assert not ranges.seekable("viewfs://x/y") and not ranges.seekable("file:///no/such/file") and ranges.seekable(f"file:{folder / 'five'}")


@pytest.mark.parametrize("mode", [BYTES, CHARS, GRAPHEMES, LINES, records("||")], ids=lambda m: f"{m.unit.name}-{m.delimiter!r}")
@pytest.mark.parametrize("text", ["3:21:4", "-9:-2", "::-1", "-2:1:-5"])
def test_inputs_in_several_files(spark, tmp_path, mode, text, monkeypatch):
    """Files that are cut after lines, within code points and clusters, or empty are read as the one that they make up."""
    monkeypatch.setattr(ranges, "PIECE", 5)
    whole = "é́中\r\na\U0001F468‍\U0001F469,\n\n\U0001F1E9\U0001F1EA\U0001F1EB,,b||c|||d\nlast".encode() + b"\xff\xe3\x81"
    cuts = {"lines": [0, 9, 9, 24, len(whole)], "anywhere": [0, 1, 2, 9, 9, 24, 40, len(whole)]}
    assert whole[8:9] == whole[23:24] == b"\n"
    inputs = []
    for name, at in cuts.items():
        parts = [tmp_path / f"{name}{k}" for k in range(len(at))]
        for part, a, b in zip(parts, at, [*at[1:], len(whole)]):
            part.write_bytes(whole[a:b])
        inputs.append(files.InParts(name, tuple(map(str, parts))))
    (tmp_path / "alone").write_bytes(whole)
    inputs.append(str(tmp_path / "alone"))
    want = model(whole, text, mode)
    for large in (0, 1000):
        got = files.output(files.select_files(spark, inputs, text, mode, large=large))
        assert got == b"".join(f"==> {name} <==\n".encode() + want for name in ("lines", "anywhere", tmp_path / "alone"))
    if mode == LINES:
        got = sorted((r.pos, bytes(r.elem)) for r in files.select_records(spark, inputs[:1], text).collect())
        assert b"".join(e for _, e in got) == want
        with pytest.raises(ValueError, match="anywhere ends within a record"):
            files.read_records(spark, inputs)


def test_an_input_whose_part_is_missing(spark, folder):
    gap = files.InParts("gap", (str(folder / "five"), str(folder / "absent")))
    with pytest.raises(files.SourceError, match="gap: No such file") as e:
        files.select_files(spark, [gap, str(folder / "five")], "-1:")
    assert files.output(e.value.result) == f"==> {folder / 'five'} <==\nline4\n".encode()
    with pytest.raises(ValueError, match="no files"):
        files.InParts("none", ())


def test_pieces_of_clusters_are_small(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"line\n" * 2_000_000)
    found, _ = files.probe(spark, [str(tmp_path / "x")])
    sizes = [len(r.content) for r in ranges.text_pieces(spark, [(f.number, f.name, f.parts, f.length) for f in found], lines=True).select("content").collect()]
    assert sum(sizes) == 10_000_000 and max(sizes) < 5 << 20
