import itertools
import os

import numpy as np
import pandas as pd
import pytest

from ordinate.plans.modes import UsageError
from ordinate.plans.ranges import parse_range
from ordinate.streaming.ranges import first_rows, placed, select_stream

COUNTER = itertools.count()


def run(spark, folder, text, by=()):
    """The rows of a stream of five files, a micro-batch each."""
    source = spark.readStream.schema("k long, g string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"out{next(COUNTER)}"
    query = select_stream(source, "k", text, by).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.sql(f"select * from {name}").collect()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stream")
    for part in range(5):
        spark.range(part * 6, part * 6 + 6).selectExpr("id as k", "if(id % 3 = 0, 'a', 'b') as g").coalesce(1).write.mode("append").parquet(str(path / "all"))
    return path / "all"


@pytest.mark.parametrize("text", [":4", "4:20", "7:", "1:25:6", "2:-3", "1:-7:4", ":", "5:2"])
def test_one_sequence(spark, folder, text):
    # Files of one age come in any order, so the order of rows is that of the batches: read the outcome against it.
    got = sorted(r.k for r in run(spark, folder, text))
    assert got == [list(range(30))[i] for i in parse_range(text).positions(30)]


def test_groups(spark, folder):
    got = sorted((r.g, r.k) for r in run(spark, folder, "1:-2:2", ["g"]))
    groups = {"a": [k for k in range(30) if k % 3 == 0], "b": [k for k in range(30) if k % 3]}
    assert got == [(g, k) for g, ks in groups.items() for k in ks[1:-2:2]]


def test_a_record_over_the_limit_fails_the_query(spark, folder):
    source = spark.readStream.schema("k long, g string").parquet(str(folder))
    for most, fails in ((1, False), (0, True)):
        query = select_stream(source, "k", ":-3", record="g", max_record_size=most).writeStream.format("noop").outputMode("append").start()
        try:
            if fails:
                with pytest.raises(Exception, match="record exceeds --max-record-size=0 bytes"):
                    query.processAllAvailable()
            else:
                query.processAllAvailable()
        finally:
            query.stop()


@pytest.mark.parametrize("text", ["-3:", "::-1"])
def test_the_end_of_a_stream_is_unknown(spark, folder, text):
    with pytest.raises(UsageError, match="depends on the end"):
        run(spark, folder, text)


def batches_of(seed: int, rows: int = 5_000, size: int = 100):
    """Batches in no order, with ties, and the same rows as one sorted table."""
    keys = np.random.default_rng(seed).integers(0, rows, rows)
    table = pd.DataFrame({"k": keys, "v": np.arange(rows), "t": [f"text {v}" for v in range(rows)]})
    return [table[at:at + size].reset_index(drop=True) for at in range(0, rows, size)], table.sort_values("k", kind="stable", ignore_index=True)


@pytest.mark.parametrize("most", [1, 90, 1_000, 10_000])
def test_the_first_rows_are_all_that_a_window_holds(most, monkeypatch):
    batches, want = batches_of(3)
    largest, concat = [], pd.concat
    monkeypatch.setattr(pd, "concat", lambda parts, **options: largest.append(sum(0 if p is None else len(p) for p in parts)) or concat(parts, **options))
    n, got = first_rows(iter(batches), "k", most)
    assert n == 5_000 and got.reset_index(drop=True).equals(want[:most])
    assert max(largest) <= min(5_000, 2 * most + 100)


@pytest.mark.parametrize("count", [1, 2, 50])
def test_places_of_rows_that_wait_in_a_file(count):
    batches, _ = batches_of(4)
    want = pd.concat(batches[:count]).sort_values("k", kind="stable", ignore_index=True)
    n, blocks = placed(iter(batches[:count]), "k")
    blocks = list(blocks)
    assert n == len(want) and len(blocks) == count and max(len(rows) for _, rows in blocks) == 100
    got = pd.concat([rows.assign(at=at) for at, rows in blocks]).sort_values("at", ignore_index=True)
    assert list(got["at"]) == list(range(n)) and got[["k", "v", "t"]].equals(want)


@pytest.mark.parametrize("text", ["4:20", "1:250:6", "2:-3", "1:-70:4", "3::7", ":99"])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_groups_of_several_batches(spark, tmp_path, text, by):
    """Micro-batches that come to Python in several batches, in no order within."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for part in range(3):
            rows = spark.range(part * 100, part * 100 + 100).selectExpr("id as k", "if(id % 3 = 0, 'a', 'b') as g")
            rows.orderBy((rows.k * 37) % 101).coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
        for k, path in enumerate(sorted((tmp_path / "all").glob("part-*.parquet"), key=lambda p: min(pd.read_parquet(p)["k"]))):
            os.utime(path, (1_000_000 + k, 1_000_000 + k))
        got = sorted((r.g if by else "", r.k) for r in run(spark, tmp_path / "all", text, by))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {"a": [k for k in range(300) if k % 3 == 0], "b": [k for k in range(300) if k % 3]} if by else {"": list(range(300))}
    assert got == [(g, ks[i]) for g, ks in groups.items() for i in parse_range(text).positions(len(ks))]
