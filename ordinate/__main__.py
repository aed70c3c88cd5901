"""``python -m ordinate RANGE [FILES]``: a range of files or of standard input, on standard output.

Exit status 0; 1 if an input cannot be read or a record is over the limit; 2 for a wrong command line.
"""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Sequence

from ordinate.plans import modes
from ordinate.plans.explain import explain
from ordinate.plans.modes import UsageError
from ordinate.plans.ranges import Kind, RangeParseError, parse_range
from ordinate.plans.translate import DIALECTS, default_dialect, translate

#: A range may begin with a minus sign; it is kept from the option parser behind a character that no argument has.
GUARD = "\0"
VERSION = "0.2.0"
BLOCK = 8 << 20
_MINUS = re.compile(r"-[0-9]|-:|--[0-9]")
_VALUED = {"-d", "--delimiter", "--max-record-size", "--io-buffer-size"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ordinate", description="Select the elements of an input in a start:end:step range.")
    p.add_argument("--version", action="version", version=f"ordinate {VERSION}")
    p.add_argument("range", metavar="RANGE")
    p.add_argument("files", metavar="FILES", nargs="*")
    unit = p.add_mutually_exclusive_group()
    unit.add_argument("-l", "--lines", action="store_true", help="lines (the default)")
    unit.add_argument("-b", "-c", "--bytes", action="store_true", help="bytes")
    unit.add_argument("--chars", action="store_true", help="code points")
    unit.add_argument("--graphemes", action="store_true", help="grapheme clusters")
    unit.add_argument("-d", "--delimiter", help="records that end in it")
    unit.add_argument("-z", "--null", action="store_true", help="records that end in NUL")
    p.add_argument("-e", "--escape", action="store_true", help="expand backslash escapes in the delimiter")
    p.add_argument("-q", action="store_true", dest="quiet", help="no headers between files")
    p.add_argument("--max-record-size", type=modes.record_limit, metavar="SIZE|unlimited")
    p.add_argument("--io-buffer-size", type=modes.byte_size, metavar="SIZE", help="accepted; never changes a result")
    action = p.add_mutually_exclusive_group()
    action.add_argument("--explain", action="store_true", help="say what the range selects and read nothing")
    action.add_argument("--translate", nargs="?", const="", metavar="DIALECT", help="print the nearest shell command and read nothing")
    return p


def guarded(arguments: Sequence[str]) -> list[str]:
    out, value = [], False
    for a in arguments:
        if a == "--translate":  # its dialect is only ever joined by "="
            a = "--translate="
        out.append(GUARD + a if not value and _MINUS.match(a) else a)
        value = not value and a in _VALUED
    return out


def main(arguments: Sequence[str] | None = None, out=None) -> int:
    out = out or sys.stdout.buffer
    p = parser()
    try:
        args = p.parse_args(guarded(sys.argv[1:] if arguments is None else arguments))
        text = args.range.removeprefix(GUARD)
        files = [f.removeprefix(GUARD) for f in args.files]
        mode = modes.mode(args.lines, args.bytes, args.chars, args.graphemes, args.delimiter, args.escape, args.null)
        if args.translate is not None and args.translate not in ("", "all", *DIALECTS):
            raise UsageError(f"unknown dialect: {args.translate}")
    except UsageError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except SystemExit as e:
        return int(e.code or 0)
    try:
        r = parse_range(text)
    except RangeParseError as e:
        print(f"error: invalid value '{text}' for '<RANGE>': {e}", file=sys.stderr)
        return 2
    if args.explain:
        out.write(explain(r, mode.unit).encode())
        return 0
    if args.translate is not None:
        out.write(translate(r, mode, args.translate or default_dialect()).encode())
        return 0
    return run(r, mode, files, args.quiet, args.max_record_size, out)


def run(r, mode, files: list[str], quiet: bool, limit: int | None, out) -> int:
    from pyspark.sql import SparkSession

    from ordinate.functions.selecting import RecordTooLarge
    from ordinate.session import ship
    from ordinate.sources.files import SourceError, select_files

    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[*]").appName("ordinate").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship(spark)
    status = 0
    try:
        if not files and r.kind is Kind.EMPTY:
            return 0
        try:
            selected = select_files(spark, files or [spooled(spark, sys.stdin.buffer)], r, mode, quiet, limit)
        except SourceError as e:
            for path, why in e.errors:
                print(f"ordinate: {path}: {why}", file=sys.stderr)
            selected, status = e.result, 1
        for row in selected.orderBy("file_no", "i").select("content").toLocalIterator():
            out.write(bytes(row["content"]))
    except RecordTooLarge as e:
        print(f"ordinate: {e}", file=sys.stderr)
        status = 1
    return status


def spooled(spark, stream) -> str:
    """A stream as a file in the shared folder, written block by block: the driver never holds more than one."""
    from ordinate.session import shared_path

    path = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "stdin"))
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        while block := stream.read(BLOCK):
            out.write(bytearray(block))
    finally:
        out.close()
    return path.toString()


if __name__ == "__main__":
    sys.exit(main())
