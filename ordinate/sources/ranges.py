"""Data sources of byte ranges, every so many bytes of them, and pieces of text: each is read by seeking, a piece to a task."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 32 << 20
#: Of pieces whose every cluster is an object of its own in Python.
LINES_PIECE = 4 << 20
SCHEMA = "file_no int, src string, i bigint, content binary"


#: The files of an input with their lengths, in the order in which they are one.
Parts = Sequence[tuple[str, int]]


class Piece(InputPartition):
    """A piece of the k-th input; the list of the input's files stays with the reader."""

    def __init__(self, k: int, start: int, at: int, size: int, step: int = 1, i: int | None = None):
        self.k, self.start, self.at, self.size, self.step = k, start, at, size, step
        self.i = at if i is None else i


def opened(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    system, inner = fs.FileSystem.from_uri("s3" + path.removeprefix("s3a") if path.startswith("s3a:") else path)
    return system.open_input_file(inner)


def seekable(path: str) -> bool:
    """Whether Python can open the file; a store may be one that only Spark's readers know."""
    try:
        opened(path).close()
    except (OSError, ValueError, NotImplementedError):  # Arrow's errors are of these kinds
        return False
    return True


class Joined:
    """Files read as one; each is opened when it is reached, one at a time."""

    def __init__(self, parts: Parts):
        self.parts, self.starts = parts, list(accumulate((size for _, size in parts), initial=0))
        self.at, self.k, self.file = 0, -1, None

    def __enter__(self) -> Joined:
        return self

    def __exit__(self, *error) -> None:
        if self.file is not None:
            self.file.close()

    def seek(self, at: int) -> None:
        self.at = at

    def tell(self) -> int:
        return self.at

    def read(self, size: int) -> bytes:
        found, end = [], min(self.at + size, self.starts[-1])
        while self.at < end:
            k = bisect_right(self.starts, self.at) - 1
            if k != self.k:
                self.__exit__()
                self.k, self.file = k, opened(self.parts[k][0])
            self.file.seek(self.at - self.starts[k])
            found.append(self.file.read(min(end, self.starts[k + 1]) - self.at))
            if not found[-1]:
                raise OSError(f"{self.parts[k][0]} is shorter than it was")
            self.at += len(found[-1])
        return found[0] if len(found) == 1 else b"".join(found)


class ByteRangeReader(DataSourceReader):
    def __init__(self, options):
        self.wanted = json.loads(options["ranges"])
        self.piece = int(options.get("piece", PIECE))

    def partitions(self) -> list[Piece]:
        out = []
        for k, (_, _, _, start, size, step) in enumerate(self.wanted):
            places = range(0, max(size, 1), self.piece)
            out += [Piece(k, start + at, at, min(self.piece, size - at), step, at if step > 0 else places[-1] - at) for at in places]
        return out

    def read(self, p: Piece) -> Iterator[tuple]:
        (number, name, parts, *_), content = self.wanted[p.k], b""
        if p.size:
            with Joined(parts) as f:
                f.seek(p.start)
                content = f.read(p.size)
        if p.step in (1, -1):
            content = content[::p.step]
        else:
            content = content[-p.at % abs(p.step)::abs(p.step)][::1 if p.step > 0 else -1]
        yield number, name, p.i, content


class ByteRanges(DataSource):
    """Options: ranges, a JSON list of [number, name, [[path, length], ...], start, size, step]; piece, the most bytes a task reads."""

    @classmethod
    def name(cls) -> str:
        return "ordinate_byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ByteRangeReader:
        return ByteRangeReader(self.options)


def byte_ranges(spark: SparkSession, wanted: list[tuple[int, str, str | Parts, int, int, int]], piece: int | None = None) -> DataFrame:
    """(file_no, src, i, content): every step-th byte of each range from its first on, in pieces in the order of i; with a
    negative step the same bytes in descending order. A range is of one file, or of several that are read as one."""
    spark.dataSource.register(ByteRanges)
    wanted = [(number, name, [(path, start + size)] if isinstance(path, str) else path, start, size, step) for number, name, path, start, size, step in wanted]
    return spark.read.format(ByteRanges.name()).option("ranges", json.dumps(wanted)).option("piece", piece or PIECE).load()


def starts_at(data: bytes, k: int) -> int:
    """Where the first code point at or after data[k] starts; data has three bytes before k and three after, where there are any.

    Well-formed sequences never overlap: only one that starts up to three bytes before can reach over k.
    """
    for p in range(max(0, k - 3), k):
        for n in range(k - p + 1, 5):
            try:
                if len(data[p:p + n]) == n and len(data[p:p + n].decode()) == 1:
                    return p + n
            except UnicodeDecodeError:
                continue
    return k


class TextPieceReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.piece, self.lines = int(options["piece"]), options["lines"] == "true"

    def partitions(self) -> list[Piece]:
        return [Piece(k, 0, at, size) for k, (_, _, _, size) in enumerate(self.files) for at in range(0, max(size, 1), self.piece)]

    def border(self, f, at: int, size: int) -> int:
        if at <= 0 or at >= size:
            return max(0, min(at, size))
        if not self.lines:
            f.seek(max(0, at - 3))
            return max(0, at - 3) + starts_at(f.read(min(at, 3) + 3), min(at, 3))
        f.seek(at - 1)  # a line feed right before ends the piece here
        while block := f.read(1 << 16):
            if (k := block.find(b"\n")) >= 0:
                return f.tell() - len(block) + k + 1
        return size

    def read(self, p: Piece) -> Iterator[tuple]:
        number, name, parts, _ = self.files[p.k]
        with Joined(parts) as f:
            first, last = self.border(f, p.at, p.size), self.border(f, p.at + self.piece, p.size)
            f.seek(first)
            yield number, name, p.at, f.read(max(0, last - first))


class TextPieces(DataSource):
    """Options: files, a JSON list of [number, name, [[path, length], ...], size]; piece, the bytes of a piece or so; lines, whether it ends with a line."""

    @classmethod
    def name(cls) -> str:
        return "ordinate_text_pieces"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TextPieceReader:
        return TextPieceReader(self.options)


def text_pieces(spark: SparkSession, files: list[tuple[int, str, Parts, int]], lines: bool, piece: int | None = None) -> DataFrame:
    """(file_no, src, i, content): inputs cut between code points, or after line feeds, in pieces in the order of i.

    No grapheme cluster reaches over a line feed. An input without any is one piece if it is cut by lines.
    """
    spark.dataSource.register(TextPieces)
    return spark.read.format(TextPieces.name()).option("files", json.dumps(files)).option("piece", piece or (min(PIECE, LINES_PIECE) if lines else PIECE)).option("lines", str(lines).lower()).load()
