"""The registered queries of the engine, and the SQL that gives the same rows.

Results are compared without regard to order, so order is a column: `pos`, the 0-based place in the output.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate import plan_queries
from ordinate.functions.selecting import elements, largest_record, select_column
from ordinate.operators.positions import with_positions
from ordinate.operators.rows import select_rows
from ordinate.plans.modes import BYTES, CHARS, GRAPHEMES, LINES, Mode, records
from ordinate.plans.ranges import parse_range
from ordinate.plans.translate import sql_bounds, sql_predicate
from ordinate.session import input_bytes, shared_path, ship
from ordinate.sources.files import InParts, SourceError, concatenated, select_files, select_records
from ordinate.streaming.ranges import select_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_oracle(name: str, columns: list[str], order_by: list[str], text: str, by: list[str]) -> str:
    """The selected rows by window functions."""
    r = parse_range(text)
    low, high = sql_bounds(r)
    group = f"partition by {', '.join(by)} " if by else ""
    place = f"(i - {low}) // {r.step}" if r.step > 0 else f"({high} - 1 - i) // {-r.step}"
    return f"""select {', '.join(columns)}, ({place})::bigint as pos
        from (select *, row_number() over ({group}order by {', '.join(order_by)}) - 1 as i, count(*) over ({group.strip()}) as n from {name})
        where {sql_predicate(r)}"""


def add_rows(query: str, name: str, columns: list[str], order_by: list[str], text: str, by: tuple[str, ...] = (), skewed: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select_rows(table(spark, sf_dir, name).select(*dict.fromkeys([*columns, *order_by, *by])), order_by, text, by=by, position="pos", skewed=skewed).select(*columns, "pos")

    QUERIES[query] = run
    ORACLES[query] = row_oracle(name, columns, order_by, text, list(by))


ORDERS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
for _name, _text in {
    "head": ":10", "offset": "14000:", "window": "100:200", "step": "10:1000:7", "step_open": "3::1000", "tail": "-10:", "tail_step": "-100::7",
    "tail_fixed_end": "-14990:20", "tail_pair": "-50:-10", "lag": "5:-14000", "lag_step": "5:-100:9", "reverse": "::-1", "reverse_stride": "::-3",
    "reverse_bounds": "500:100:-7", "reverse_from_end": "-3:-40:-2", "reverse_depends": "50:-14980:-1", "empty": "5:3", "empty_tail": "-2:-5", "copy": ":",
    "overshoot": "-99999999:", "past_end": "99999999:", "relative": "100:+20", "around": "100:+-5", "tail_relative": "-50:+20", "tail_around": "-50:+-5", "minus_zero": "-0:3",
    "largest_index": ":18446744073709551615",
}.items():
    add_rows(f"orders_rows_{_name}", "orders", ORDERS, ["o_orderkey"], _text)

LINEITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
for _name, _text in {"head": ":2", "window": "1:3", "tail": "-2:", "tail_pair": "-3:-1", "reverse": "::-1", "reverse_stride": "-2::-2", "step": "::2"}.items():
    add_rows(f"lineitem_group_{_name}", "lineitem", LINEITEM, LINEITEM[1:], _text, ("l_orderkey",))
add_rows("lineitem_rows_deep_window", "lineitem", LINEITEM, LINEITEM, "20000:50000:3")
add_rows("lineitem_group_skewed", "lineitem", LINEITEM, LINEITEM, "-400:-100:5", ("l_returnflag",), skewed=True)
for _name, _text in {"lag": ":-5", "lag_step": "1:-2:2", "tail": "-3:"}.items():
    add_rows(f"events_group_{_name}", "events", ["event_id", "user_id", "event_type", "value"], ["event_id"], _text, ("user_id",))
add_rows("conversations_group_window", "conversations", ["conv_id", "turn", "role"], ["turn"], "1:3", ("conv_id",))
add_rows("conversations_group_reverse", "conversations", ["conv_id", "turn", "role"], ["turn"], "-1:0:-1", ("conv_id",))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_positions(table(spark, sf_dir, "lineitem").select(*LINEITEM), LINEITEM, "i", "n")


QUERIES["lineitem_positions"] = positions
ORACLES["lineitem_positions"] = f"select {', '.join(LINEITEM)}, row_number() over (order by {', '.join(LINEITEM)}) - 1 as i, count(*) over () as n from lineitem"


def list_oracle(text: str, n: str, element: str, glue: str = "''") -> str:
    """The selected ones of n elements; `element` is SQL for the one at 0-based i."""
    r = parse_range(text)
    order = "list_reverse" if r.step < 0 else ""
    return f"coalesce(array_to_string({order}([{element} for i in range({n}) if {sql_predicate(r, 'i', n)}]), {glue}), '')"


def add_column(query: str, name: str, key: str, column: str, text: str, mode: Mode) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cut = select_column(column, text, mode)
        return table(spark, sf_dir, name).select(key, (F.hex(cut) if mode == BYTES else cut).alias("part"))

    QUERIES[query] = run
    r = parse_range(text)
    if mode == CHARS:
        cut = list_oracle(text, "n", "e[i + 1]")
        ORACLES[query] = f"select {key}, {cut} as part from (select {key}, string_split({column}, '') as e, length({column}) as n from {name})"
    elif mode == BYTES:
        cut = list_oracle(text, "n", "substr(h, (2 * i + 1)::bigint, 2)")
        ORACLES[query] = f"select {key}, {cut} as part from (select {key}, hex(encode({column})) as h, strlen({column}) as n from {name})"
    elif mode.delimited:
        by = "chr(10)" if mode == LINES else "'" + mode.delimiter.decode() + "'"
        split = f"""select {key}, string_split({column}, {by}) as p, ends_with({column}, {by}) or {column} = '' as closed,
                    len(string_split({column}, {by})) - (ends_with({column}, {by}) or {column} = '')::int as n from {name}"""
        if r.step > 0:
            cut = list_oracle(text, "n", f"p[i + 1] || case when i < n - 1 or closed then {by} else '' end")
        else:
            chosen = list_oracle(text, "n", "p[i + 1]", by)
            last = f"len([i for i in range(n) if {sql_predicate(r)} and i = n - 1]) = 1"
            some = f"len([i for i in range(n) if {sql_predicate(r)}]) > 0"
            cut = f"{chosen} || case when {some} and (closed or not {last}) then {by} else '' end"
        ORACLES[query] = f"select {key}, {cut} as part from ({split})"


DOCUMENT = ("documents", "doc_id", "text")
for _name, _text in {"window": "10:200", "step": "5:500:7", "tail": "-40:", "tail_pair": "-40:-10", "tail_step": "-100::9", "lag": "20:-20", "lag_step": ":-9:5", "reverse": "::-1", "reverse_bounds": "300:3:-11", "head": ":80", "empty": "4:4", "relative": "-30:+12"}.items():
    add_column(f"documents_chars_{_name}", *DOCUMENT, _text, CHARS)
for _name, _text in {"window": "1:3", "step": "::2", "tail": "-2:", "lag": "1:-1", "lag_step": ":-1:2", "reverse": "::-1", "reverse_stride": "-1::-2", "reverse_part": "-2:0:-1", "tail_fixed_end": "-3:2"}.items():
    add_column(f"documents_lines_{_name}", *DOCUMENT, _text, LINES)
for _name, _by, _text in (("space_window", " ", "3:9"), ("space_step", " ", "::10"), ("space_tail", " ", "-4:"), ("space_reverse", " ", "::-1"), ("pair_window", ", ", "1:4"), ("pair_lag", ", ", ":-1"), ("pair_reverse", ", ", "::-2")):
    add_column(f"documents_delim_{_name}", *DOCUMENT, _text, records(_by))
for _name, _text in {"window": "3:40", "tail": "-25:", "step": "::50", "lag_step": "4:-4:40", "reverse": "60::-1"}.items():
    add_column(f"documents_bytes_{_name}", *DOCUMENT, _text, BYTES)
add_column("pages_delim_tags", "pages", "page_id", "html", "2:6", records("><"))
add_column("pages_delim_tags_reverse", "pages", "page_id", "html", "-3::-1", records("><"))


def documents_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(elements("text", LINES)).alias("i", "line"))
    return lines.select("doc_id", F.col("i").cast("bigint").alias("i"), "line")


QUERIES["documents_line_elements"] = documents_elements
ORACLES["documents_line_elements"] = r"""
    select doc_id, unnest(range(len(e))) as i, unnest(e) as line from (select doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+$') as e from documents)"""


def documents_graphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", select_column("text", "-20:-2", GRAPHEMES).alias("part"))


#: No grapheme of these texts is longer than a code point, so that SQL by code points gives the same.
QUERIES["documents_graphemes_tail"] = documents_graphemes
ORACLES["documents_graphemes_tail"] = f"select doc_id, {list_oracle('-20:-2', 'n', 'e[i + 1]')} as part from (select doc_id, string_split(text, '') as e, length(text) as n from documents)"

def add_clusters(query: str, text: str) -> None:
    """Texts whose every e carries an accent of its own and whose lines end in CR LF, so that many clusters are two code points."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        joined = F.regexp_replace(F.regexp_replace("text", "e", "e\u0301"), "\n", "\r\n")
        return table(spark, sf_dir, "documents").select("doc_id", joined.alias("text")).select("doc_id", select_column("text", text, GRAPHEMES).alias("part"))

    QUERIES[query] = run
    ORACLES[query] = rf"""select doc_id, {list_oracle(text, 'n', 'e[i + 1]')} as part from (select doc_id, e, len(e) as n from
        (select doc_id, regexp_extract_all(replace(replace(text, 'e', 'e' || chr(769)), chr(10), chr(13) || chr(10)), '(?s)\r\n|.\x{{301}}?') as e from documents))"""


for _name, _text in {"window": "3:90", "step": "2:400:7", "lag": "20:-20", "lag_step": ":-9:5", "reverse": "::-1", "reverse_bounds": "300:3:-11", "tail_step": "-100::9"}.items():
    add_clusters(f"documents_clusters_{_name}", _text)


def nul_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words ended by NUL in binary values."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", " ", "\0").cast("binary").alias("words"))
    cut = select_column("words", "-9:-2:2", records(b"\0"), binary=True)
    return words.select("doc_id", F.regexp_replace(cut.cast("string"), "\0", " ").alias("part"))


QUERIES["documents_nul_records"] = nul_records
ORACLES["documents_nul_records"] = f"""select doc_id, {list_oracle('-9:-2:2', 'n', "p[i + 1] || case when i < n - 1 or closed then ' ' else '' end")} as part from
    (select doc_id, string_split(text, ' ') as p, ends_with(text, ' ') or text = '' as closed, len(string_split(text, ' ')) - (ends_with(text, ' ') or text = '')::int as n from documents)"""

# Well-formed UTF-8 in hex, a code point a match, or else a byte.
CODE_POINTS_IN_HEX = "[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|E[1-9A-CEF](?:[89AB].){2}|ED[89].[89AB].|F0[9AB].(?:[89AB].){2}|F[1-3](?:[89AB].){3}|F48.(?:[89AB].){2}|.."


def add_malformed(query: str, text: str) -> None:
    """Bytes that are no UTF-8 before and after a piece of each text, which is cut anywhere."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = F.concat(F.unhex(F.lit("FFE38182C0AF")), F.substring(F.col("text").cast("binary"), 1, 301), F.unhex(F.lit("80EDA080F4908080E381")))
        return table(spark, sf_dir, "documents").select("doc_id", data.alias("data")).select("doc_id", F.hex(select_column("data", text, CHARS, binary=True)).alias("part"))

    QUERIES[query] = run
    ORACLES[query] = f"""select doc_id, {list_oracle(text, 'n', 'e[i + 1]')} as part from (select doc_id, e, len(e) as n from
        (select doc_id, regexp_extract_all('FFE38182C0AF' || substr(hex(encode(text)), 1, 602) || '80EDA080F4908080E381', '{CODE_POINTS_IN_HEX}') as e from documents))"""


for _name, _text in {"window": "1:90", "step": "::7", "lag": "2:-3", "tail": "-12:", "reverse": "::-1"}.items():
    add_malformed(f"documents_malformed_{_name}", _text)


def add_limit(query: str, text: str, held: str) -> None:
    """The size of the largest line of each document that a record limit applies to; `held` is SQL for the lines' list e."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", largest_record("text", text).cast("bigint").alias("largest"))

    QUERIES[query] = run
    ORACLES[query] = rf"""select doc_id, list_max([strlen(x) for x in {held}])::bigint as largest from (select doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+$') as e from documents)"""


add_limit("documents_limit_tail", "-2:", "e")
add_limit("documents_limit_tail_fixed_end", "-9:3", "e[1:3]")
add_limit("documents_limit_lag_step", "1:-1:2", "[e[i + 1] for i in range(len(e)) if i % 2 = 1]")
add_limit("documents_limit_reverse", "-2::-3", "e")


#: Bytes of the documents' table to a task that writes lines; texts are several times larger than their table.
LINES_BYTES = 8 << 20


def raw_lines(spark: SparkSession, sf_dir: str) -> list[InParts]:
    """All documents as lines, one input a language, written by Spark in parts: no task sees all of a language."""
    path = shared_path(spark, "lines")
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    tasks = max(spark.sparkContext.defaultParallelism, input_bytes(docs) // LINES_BYTES)
    docs.repartitionByRange(tasks, "lang", "doc_id").sortWithinPartitions("lang", "doc_id").select("lang", "text").write.partitionBy("lang").option("lineSep", "\n").text(path)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path").collect()
    parts = groupby(sorted(r["path"] for r in listed), lambda name: name.rpartition("/")[0])  # numbered in the order of their ranges
    return [InParts(folder, tuple(names)) for folder, names in parts]


FILES_SQL = """select lang, (row_number() over (order by lang) - 1)::int as file_no, string_agg(text, chr(10) order by doc_id) || chr(10) as content from documents group by lang"""
LINES_SQL = f"""select file_no, unnest(range(len(e) - 1)) as i, unnest(e[:-2]) as elem, len(e) - 1 as n from (select file_no, string_split(content, chr(10)) as e from ({FILES_SQL}))"""


def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = select_records(spark, raw_lines(spark, sf_dir), "3:-40:4")
    return selected.select("file_no", "pos", F.col("elem").cast("string").alias("elem"))


QUERIES["files_lines_step"] = file_records
ORACLES["files_lines_step"] = f"select file_no, (i - least(3, n)) // 4 as pos, elem || chr(10) as elem from ({LINES_SQL}) where {sql_predicate('3:-40:4')}"


def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = concatenated(select_files(spark, raw_lines(spark, sf_dir), "-2:"))
    return out.select("file_no", F.regexp_replace(F.col("content").cast("string"), "(?s)^==> [^\n]* <==", "==> <==").alias("content"))


QUERIES["files_header_concat"] = file_headers
ORACLES["files_header_concat"] = f"select file_no, '==> <==' || chr(10) || string_agg(elem || chr(10), '' order by i) as content from ({LINES_SQL}) where {sql_predicate('-2:')} group by file_no"


def file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = select_files(spark, raw_lines(spark, sf_dir), "-300:-100", BYTES, quiet=True)
    return selected.select("file_no", "i", F.hex("content").alias("content"))


QUERIES["files_bytes_tail"] = file_bytes
ORACLES["files_bytes_tail"] = f"select file_no, 0::bigint as i, substr(h, length(h) - 599, 400) as content from (select file_no, hex(encode(content)) as h from ({FILES_SQL}))"


def add_file_parts(query: str, text: str, mode: Mode) -> None:
    """Files read by pieces, as large ones are."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return concatenated(select_files(spark, raw_lines(spark, sf_dir), text, mode, quiet=True, large=0)).select("file_no", F.col("content").cast("string").alias("content"))

    QUERIES[query] = run
    ORACLES[query] = f"select file_no, {list_oracle(text, 'n', 'e[i + 1]')} as content from (select file_no, string_split(content, '') as e, length(content) as n from ({FILES_SQL}))"


add_file_parts("files_chars_lag_step", "50:-100:90", CHARS)
add_file_parts("files_chars_reverse", "-500:-90:-3", CHARS)
#: No grapheme of these texts is longer than a code point.
add_file_parts("files_graphemes_tail", "-400:-100", GRAPHEMES)


def strided_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = select_files(spark, raw_lines(spark, sf_dir), "-10:200:-1000", BYTES, quiet=True)
    return concatenated(selected).select("file_no", F.hex("content").alias("content"))


QUERIES["files_bytes_reverse_stride"] = strided_bytes
ORACLES["files_bytes_reverse_stride"] = f"select file_no, {list_oracle('-10:200:-1000', 'n', 'substr(h, (2 * i + 1)::bigint, 2)')} as content from (select file_no, hex(encode(content)) as h, strlen(content) as n from ({FILES_SQL}))"


def missing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which the second is not there: the others' parts, and the error."""
    paths = raw_lines(spark, sf_dir)
    missing = paths[0].name + "-that-is-not-there"
    paths.insert(1, missing)
    try:
        select_files(spark, paths, "-2:")
    except SourceError as e:
        errors = spark.createDataFrame([(paths.index(path), None, why) for path, why in e.errors], "file_no int, content string, error string")
        content = F.regexp_replace(F.col("content").cast("string"), "(?s)^==> [^\n]* <==", "==> <==").alias("content")
        return concatenated(e.result).select("file_no", content, F.lit(None).cast("string").alias("error")).unionByName(errors)
    raise AssertionError("a missing file was found")


QUERIES["files_missing"] = missing_file
ORACLES["files_missing"] = f"""
    select (file_no + (file_no > 0)::int)::int as file_no, '==> <==' || chr(10) || string_agg(elem || chr(10), '' order by i) as content, null::varchar as error
    from ({LINES_SQL}) where {sql_predicate('-2:')} group by file_no
    union all select 1::int, null, 'No such file or directory (os error 2)'"""


def add_stream(query: str, text: str, by: tuple[str, ...]) -> None:
    """The events as a stream, a range of each user or of all, run to the end of what is there."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        schema = table(spark, sf_dir, "events").select("event_id", "user_id", "value").schema
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
        out, state = shared_path(spark, "stream"), shared_path(spark, "stream-state")
        query = select_stream(stream, "event_id", text, by).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(schema).parquet(out)

    QUERIES[query] = run
    group = f"partition by {', '.join(by)} " if by else ""
    ORACLES[query] = f"""
    select event_id, user_id, value from (select *, row_number() over ({group}order by event_id) - 1 as i, count(*) over ({group.strip()}) as n from events)
    where {sql_predicate(text)}"""


for _name, _text, _by in (("lag", "1:-2:2", ("user_id",)), ("copy", ":", ()), ("head", ":3", ("user_id",)), ("window", "100:900", ()), ("step", "1::3", ("user_id",)), ("lag_all", "5:-40:9", ())):
    add_stream(f"events_stream_{_name}", _text, _by)

QUERIES |= plan_queries.QUERIES
ORACLES |= plan_queries.ORACLES
