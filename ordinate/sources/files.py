"""Ranges of raw files: one input each, positions counted anew, outputs in the order of the list.

Small files are read with Spark's binary source and selected from as values. Byte ranges are read by seeking, delimited
files too large for one value by the text source, whose splits are numbered without moving any data, and characters and
clusters of such files by pieces that are cut between them. An input may lie in several files, as Spark writes them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordinate.functions.selecting import RecordTooLarge, clusters, select_texts
from ordinate.operators.positions import IN_TASK
from ordinate.plans.modes import LINES, Mode, Unit
from ordinate.plans.ranges import Kind, Range, as_range
from ordinate.plans.translate import sql_bounds, sql_predicate
from ordinate.session import stored
from ordinate.sources.ranges import SCHEMA, byte_ranges, seekable, text_pieces

#: Bytes of a file up to which it is one value.
LARGE = 64 << 20

MOST_STEP = (1 << 63) - 1


class SourceError(OSError):
    """Some of the named files cannot be read; `.result` holds what the others give."""

    def __init__(self, errors: list[tuple[str, str]], result: DataFrame | None = None):
        super().__init__("; ".join(f"{path}: {why}" for path, why in errors))
        self.errors, self.result = errors, result


@dataclass(frozen=True)
class InParts:
    """One input that lies in several files, in their order; headers and errors name it by its name."""

    name: str
    paths: tuple[str, ...]

    def __post_init__(self):
        if not self.paths:
            raise ValueError(f"{self.name} has no files")


@dataclass(frozen=True)
class Found:
    number: int
    name: str
    parts: tuple[tuple[str, int], ...]

    @property
    def length(self) -> int:
        return sum(size for _, size in self.parts)

    @property
    def paths(self) -> list[str]:
        return [path for path, _ in self.parts]


def probe(spark: SparkSession, paths: Sequence[str | InParts]) -> tuple[list[Found], list[tuple[str, str]]]:
    """The inputs of the list that can be opened, with their lengths, and an error for each of the others. No globs: each name is one file."""
    found, errors = [], []
    for number, given in enumerate(paths):
        name, parts = (given.name, given.paths) if isinstance(given, InParts) else (given, (given,))
        try:
            sizes = []
            for part in parts:
                path = spark._jvm.org.apache.hadoop.fs.Path(part)
                fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
                if not fs.exists(path):
                    raise FileNotFoundError("No such file or directory (os error 2)")
                if fs.getFileStatus(path).isDirectory():
                    raise IsADirectoryError("Is a directory (os error 21)")
                sizes.append((fs.makeQualified(path).toString(), fs.getFileStatus(path).getLen()))
            found.append(Found(number, name, tuple(sizes)))
        except Exception as e:  # the file system's own reasons, such as permissions
            errors.append((name, str(e).splitlines()[0]))
    return found, errors


def select_files(spark: SparkSession, paths: Sequence[str | InParts], text: Range | str, mode: Mode = LINES, quiet: bool = False, max_record_size: int | None = None, strict: bool = True, large: int | None = None) -> DataFrame:
    """(file_no, src, i, content): what the range selects of each file at i >= 0, after its header at i = -1.

    Headers come with more than one file unless quiet. The output in bytes is content in the order of file_no and i.
    Files that cannot be opened get no header; with strict, SourceError is raised for them and holds the result of the rest.

    Bytes are read by seeking to them. Files of up to `large` bytes (LARGE) are one value each; of larger ones records are
    read by splits, code points and clusters by pieces. A large file is still one value if its delimiter can overlap itself or is
    no UTF-8, since a split cannot tell where records begin then; and so is any file, unless read by records, of a store
    that only Spark's readers can open. An input in several files (InParts) is one value, too, if one of them ends within a record.
    """
    r = as_range(text)
    found, errors = probe(spark, paths)
    can_part = splits(mode.delimiter) if mode.delimited else bool(found) and seekable(found[0].paths[0])
    whole, parted = [], []
    for f in found:
        cut = can_part and f.length > (LARGE if large is None else large) and (not mode.delimited or _cut_between(spark, f, mode.delimiter))
        (parted if cut else whole).append(f)
    if r.kind is Kind.EMPTY or not found:
        parts = spark.createDataFrame([(f.number, f.name, 0, bytearray()) for f in found], SCHEMA)
    elif mode.unit is Unit.BYTES and can_part:
        parts = _of_bytes(spark, found, r)
    else:
        parts = _whole(spark, whole, r, mode, max_record_size) if whole else spark.createDataFrame([], SCHEMA)
        if parted and mode.delimited:
            records = _selected(_records(spark, parted, mode), r, mode, max_record_size)
            parts = parts.unionByName(records.select("file_no", "src", F.col("pos").alias("i"), F.col("elem").alias("content")))
        elif parted:
            parts = parts.unionByName(_of_pieces(spark, parted, r, mode, max_record_size))
    if len(paths) > 1 and not quiet:
        heads = spark.createDataFrame([(f.number, f.name, -1, bytearray(f"==> {f.name} <==\n".encode())) for f in found], SCHEMA)
        parts = parts.unionByName(heads)
    if errors and strict:
        raise SourceError(errors, parts)
    return parts


def splits(delimiter: bytes) -> bool:
    """Whether a file can be cut into records from anywhere in it: no end of the delimiter is also its beginning."""
    try:
        delimiter.decode()
    except UnicodeDecodeError:
        return False
    return not any(delimiter.startswith(delimiter[k:]) for k in range(1, len(delimiter)))


def _cut_between(spark: SparkSession, f: Found, delimiter: bytes) -> bool:
    """Whether no record of an input in several files begins in one and ends in another."""
    filled = [part for part in f.parts if part[1]]
    return all(_ends_with(spark, *part, delimiter) for part in filled[:-1])


def _whole(spark: SparkSession, found: list[Found], r: Range, mode: Mode, limit: int | None) -> DataFrame:
    names = spark.createDataFrame([(f.number, f.name, path, k, len(f.parts)) for f in found for k, path in enumerate(f.paths)], "file_no int, src string, path string, i int, parts int")
    read = spark.read.format("binaryFile").load(sorted({path for f in found for path in f.paths})).select("path", "content")
    held = read.join(F.broadcast(names), "path")  # as many rows as files were named
    if any(len(f.parts) > 1 for f in found):
        held = held.where("parts = 1").select("file_no", "src", "content").unionByName(concatenated(held.where("parts > 1")))
    return select_texts(held, "content", r, mode, max_record_size=limit).select("file_no", "src", F.lit(0).cast("bigint").alias("i"), "content")


def _of_bytes(spark: SparkSession, found: list[Found], r: Range) -> DataFrame:
    """Lengths make the range static; only the bytes from its first to its last are read. Many come in several rows."""
    wanted = []
    for f in found:
        chosen = r.positions(f.length)
        low, high = (min(chosen[0], chosen[-1]), max(chosen[0], chosen[-1]) + 1) if chosen else (0, 0)
        # Pieces go up from the lowest byte that is selected; backwards they are numbered down.
        wanted.append((f.number, f.name, f.parts, low, high - low, r.step if abs(r.step) < 1 << 62 else (1 << 62) * (1 if r.step > 0 else -1)))
    return byte_ranges(spark, wanted)


def _of_pieces(spark: SparkSession, found: list[Found], r: Range, mode: Mode, limit: int | None) -> DataFrame:
    """Elements are counted by piece, and those of each piece taken whose positions are in the range."""
    pieces = text_pieces(spark, [(f.number, f.name, f.parts, f.length) for f in found], lines=mode.unit is Unit.GRAPHEMES)
    graphemes, start, end, step = mode.unit is Unit.GRAPHEMES, r.start, r.end, r.step

    def split(content: bytes) -> list[bytes] | str:
        return clusters(content) if graphemes else content.decode("utf-8", "surrogateescape")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(split(v.as_py())) for v in batch.column(3)], pa.int64())], names=["file_no", "i", "n"])

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [max((len(e) for k, e in enumerate(split(content.as_py()), first.as_py()) if held(k)), default=0) for content, first in zip(batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["size"])

    def held(k: int) -> bool:
        """Whether a limit applies to the element, as largest_record() has it."""
        if start < 0:
            return end is None or end < 0 or k < end
        return step < 0 or k >= start and (k - start) % step == 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, first, n in zip(*(batch.column(k) for k in (3, 4, 5))):
                here, chosen = split(content.as_py()), range(*slice(start, end, step).indices(n.as_py()))
                low = first.as_py()
                # The selected positions within [low, low + len(here)) are neighbours among all selected ones.
                if step > 0:
                    a, b = bisect_left(chosen, low), bisect_left(chosen, low + len(here))
                else:
                    a, b = (bisect_left(chosen, -p, key=lambda x: -x) for p in (low + len(here) - 1, low - 1))
                taken = [here[p - low] for p in chosen[a:b]]
                out.append(b"".join(taken) if graphemes else "".join(taken).encode("utf-8", "surrogateescape"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["file_no", "src", "i", "content"])

    counts = stored(pieces.mapInArrow(count, "file_no int, i bigint, n bigint"), "counts")
    of_file = Window.partitionBy("file_no")
    before = of_file.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    last = F.max("i").over(of_file)
    places = counts.select("file_no", "i", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(of_file).alias("all"), (F.col("i") if step > 0 else last - F.col("i")).alias("place"))
    placed = pieces.join(places, ["file_no", "i"]).select("file_no", "src", "place", "content", "first", "all")
    if limit is not None and graphemes and r.kind in (Kind.TAIL, Kind.LAG, Kind.REVERSE):
        worst = placed.mapInArrow(largest, "size bigint").agg(F.max("size").alias("worst")).first()["worst"]
        if worst is not None and worst > limit:
            raise RecordTooLarge(limit)
    return placed.mapInArrow(cut, SCHEMA)


def output(selected: DataFrame) -> bytes:
    """The bytes that select_files() describes, on the driver: for small results and tests."""
    return b"".join(bytes(r["content"]) for r in selected.orderBy("file_no", "i").select("content").toLocalIterator())


def concatenated(selected: DataFrame) -> DataFrame:
    """One row a file: file_no, src, content with the header glued on."""
    parts = F.array_sort(F.collect_list(F.struct("i", F.decode("content", "ISO-8859-1").alias("c"))))
    return selected.groupBy("file_no", "src").agg(F.encode(F.array_join(F.transform(parts, lambda x: x["c"]), ""), "ISO-8859-1").alias("content"))


def read_records(spark: SparkSession, paths: Sequence[str | InParts], mode: Mode = LINES) -> DataFrame:
    """(file_no, src, i, n, elem, terminated) of delimited files of any size.

    A record's position is its place in its split plus the records of the splits before. Splits are numbered by two scans
    and a join with a broadcast row a split; no record is shuffled.
    """
    if not mode.delimited:
        raise ValueError("only lines and delimited records are read one by one")
    if not splits(mode.delimiter):
        raise ValueError("a delimiter that can overlap itself or is no UTF-8 does not tell where records begin in a split")
    found, errors = probe(spark, paths)
    if errors:
        raise SourceError(errors)
    for f in found:
        if not _cut_between(spark, f, mode.delimiter):
            raise ValueError(f"a file of {f.name} ends within a record")
    return _records(spark, found, mode)


def _records(spark: SparkSession, found: list[Found], mode: Mode) -> DataFrame:
    by = mode.delimiter.decode()
    rows = []
    for f in found:
        last = next((part for part in reversed(f.parts) if part[1]), f.parts[-1])
        closed = _ends_with(spark, *last, mode.delimiter)
        rows += [(f.number, f.name, path, k, closed) for k, path in enumerate(f.paths)]
    names = spark.createDataFrame(rows, "file_no int, src string, path string, part int, closed boolean")
    text = spark.read.option("lineSep", by).text(sorted({path for f in found for path in f.paths})).select(
        F.col("value").cast("binary").alias("elem"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"))
    sizes = text.groupBy("path", "block").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    of_file = Window.partitionBy("file_no")
    before = of_file.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(F.broadcast(names), "path").select("file_no", "src", "closed", "path", "block", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(of_file).alias("n"))
    out = text.join(F.broadcast(starts), ["path", "block"]).withColumn("i", F.col("start") + (F.col("id") - F.col("first")).bitwiseAND(F.lit(IN_TASK)))
    return out.select("file_no", "src", "i", "n", "elem", (F.col("closed") | (F.col("i") < F.col("n") - 1)).alias("terminated"))


def select_records(spark: SparkSession, paths: Sequence[str | InParts], text: Range | str, mode: Mode = LINES, max_record_size: int | None = None) -> DataFrame:
    """(file_no, src, pos, elem): the selected records of files of any size, with their delimiters.

    Backwards, the delimiter that a file's last record lacks is missing from the record that comes last in the output. A
    record over the limit, where one applies, raises before any is returned.
    """
    return _selected(read_records(spark, paths, mode), as_range(text), mode, max_record_size)


def _selected(records: DataFrame, r: Range, mode: Mode, limit: int | None) -> DataFrame:
    low, high = sql_bounds(r)
    if limit is not None and r.kind in (Kind.TAIL, Kind.LAG, Kind.REVERSE):
        # The records that largest_record() looks at, one by one.
        if r.kind is Kind.TAIL and r.end is not None and r.end >= 0:
            held = F.col("i") < r.end
        elif r.kind is Kind.LAG:
            held = (F.col("i") >= r.start) & ((F.col("i") - r.start) % min(r.step, MOST_STEP) == 0)
        else:
            held = F.lit(True)
        size = F.octet_length("elem") + F.when(F.col("terminated"), len(mode.delimiter)).otherwise(0)
        worst = records.where(held).agg(F.max(size).alias("worst")).first()["worst"]
        if worst is not None and worst > limit:
            raise RecordTooLarge(limit)
    place = f"(i - {low})" if r.step > 0 else f"({high} - 1 - i)"
    chosen = records.where(sql_predicate(r)).withColumn("pos", F.expr(f"{place} div {abs(r.step)}"))
    by = F.lit(mode.delimiter).cast("binary")
    if r.step > 0:
        ends = F.col("terminated")
    else:
        # The lowest selected position comes last; it lacks the delimiter if the unterminated record is selected, which can only come first.
        last = F.expr(f"i - {abs(r.step)} < {low}")
        ends = ~last | ~F.max(~F.col("terminated")).over(Window.partitionBy("file_no")) if r.kind is Kind.REVERSE else F.lit(True)
    return chosen.select("file_no", "src", "pos", F.when(ends, F.concat("elem", by)).otherwise(F.col("elem")).alias("elem"))


def _ends_with(spark: SparkSession, name: str, length: int, delimiter: bytes) -> bool:
    """Whether a file's last bytes are the delimiter: a read of those bytes alone."""
    if length < len(delimiter):
        return length == 0
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(length - len(delimiter))
        return bytes(stream.read() for _ in range(len(delimiter))) == delimiter
    finally:
        stream.close()
