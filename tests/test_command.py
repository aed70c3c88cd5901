import io

import pytest

from ordinate.__main__ import main


def call(*arguments):
    out = io.BytesIO()
    return main(arguments, out), out.getvalue()


def test_words_without_input():
    assert call("--explain", "-5:")[1].startswith(b"start: 5 from the end\n")
    assert call("--explain", "-b", "::-1", "no-such-file")[1].startswith(b"start: last byte\n")
    assert call("--explain", "-d", "", ":5")[1].endswith(b"from the 1st byte to the 5th byte\ncount: 5\n")
    assert call("--translate=bsd", "::-1") == (0, b"# bsd\ntail -r\n")
    assert call("--translate", ":3")[0] == 0
    assert call("--translate=all", "--graphemes", ":")[1].count(b"\ncat\n") == 4


@pytest.mark.parametrize("arguments, message", [
    (["3"], "error: invalid value '3' for '<RANGE>': range requires a ':' separator (e.g. '3:4', '3:', or ':3')"),
    (["-:"], "error: invalid value '-:' for '<RANGE>': invalid start value '-': invalid digit found in string"),
    (["--1:"], "error: invalid value '--1:' for '<RANGE>': invalid start value '--1': invalid digit found in string"),
    (["-e", "-d", r"\q", ":1"], r"error: unknown escape sequence `\q`"),
    (["-e", ":1"], "escape requires a delimiter"),
    (["-b", "--chars", ":1"], "not allowed with"),
    (["--explain", "--translate", ":1"], "not allowed with"),
    (["--max-record-size", "0", ":1"], "invalid"),
    (["--translate=x", ":1"], "unknown dialect"),
    ([], "required"),
])
def test_wrong_command_lines(arguments, message, capsys):
    assert call(*arguments) == (2, b"")
    assert message in capsys.readouterr().err


def test_files(spark, tmp_path, capsys):
    (tmp_path / "a").write_bytes(b"1\n2\n3")
    (tmp_path / "b").write_bytes(b"x,y,z,")
    a, b, c = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "c")
    assert call("-2:", a) == (0, b"2\n3")
    assert call("-q", "-d", ",", "::-1", b, b) == (0, b"z,y,x,z,y,x,")
    assert call("--io-buffer-size", "1B", "1:", a, b) == (0, f"==> {a} <==\n2\n3==> {b} <==\n".encode())
    assert call(":1", a, c, a) == (1, f"==> {a} <==\n1\n==> {a} <==\n1\n".encode())
    assert f"ordinate: {c}: No such file or directory" in capsys.readouterr().err
    assert call("--max-record-size", "1", "-1:", a) == (1, b"")
    assert "record exceeds --max-record-size=1 bytes" in capsys.readouterr().err
    assert call("--max-record-size", "unlimited", "-1:", a) == (0, b"3")


def test_standard_input(spark, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO("a\0b\0é\0".encode())))
    assert call("-z", "-2:") == (0, "b\0é\0".encode())
    assert call("5:3") == (0, b"")


def test_version(capsys):
    assert call("--version")[0] == 0
    assert capsys.readouterr().out.startswith("ordinate ")
