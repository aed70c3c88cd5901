import itertools

import pytest
from pyspark.sql import functions as F

from ordinate.operators import positions, rows
from ordinate.plans.ranges import parse_range

RANGES = ["5:3", ":", ":4", "7:", "3:9", "::3", "2:11:4", "-4:", "-9::4", "-9:8", "-9:-3", "-9:-2:3", "2:-3", ":-4:3", "::-1", "::-4", "9:2:-2", "-3::-1", "-3:1:-3", "4:-9:-1", "-99:", "99:", ":-99", "4:+3", "4:+-2", "-6:+3", ":18446744073709551615", "18446744073709551615:"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k * 7 % 12, f"v{k * 7 % 12}") for k in range(12)], "k int, v string").repartition(3).cache()


@pytest.mark.parametrize("top", [100_000, 2])
@pytest.mark.parametrize("text", RANGES)
def test_table(table, text, top, monkeypatch):
    monkeypatch.setattr(rows, "TOP", top)
    want = [list(range(12))[i] for i in parse_range(text).positions(12)]
    if text != ":":
        assert [r.k for r in rows.select_rows(table, "k", text).collect()] == want
    placed = rows.select_rows(table, "k", text, position="pos")
    assert placed.columns == ["k", "v", "pos"]
    assert sorted((r.pos, r.k) for r in placed.collect()) == list(enumerate(want))


@pytest.mark.parametrize("skewed", [False, True])
@pytest.mark.parametrize("text", [":", ":2", "1:", "::2", "-2:", "-3:-1", "-3::2", "1:-1", ":-1:2", "::-1", "3:0:-2", "-4:2", "4:-3:-1"])
def test_groups(spark, text, skewed):
    data = [(g, k) for g, n in (("a", 6), ("b", 1), ("c", 3), (None, 4)) for k in range(n)]
    df = spark.createDataFrame(data, "g string, k int").repartition(3)
    got = {}
    for r in rows.select_rows(df, "k", text, by=["g"], position="pos", skewed=skewed).collect():
        got.setdefault(r.g, []).append((r.pos, r.k))
    for g, group in itertools.groupby(data, key=lambda x: x[0]):
        keys = [k for _, k in group]
        assert sorted(got.get(g, [])) == list(enumerate(keys[i] for i in parse_range(text).positions(len(keys))))


def test_empty_table(spark):
    none = spark.createDataFrame([], "k int")
    for text in RANGES:
        assert rows.select_rows(none, "k", text, position="pos").count() == 0


def test_a_static_empty_range_reads_nothing(table):
    plan = rows.select_rows(table, "k", "5:3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("LocalRelation <empty>")


def test_a_head_is_one_top_k(table):
    plan = rows.select_rows(table, "k", "2:5")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "SinglePartition" not in plan


def test_group_heads_and_tails_are_cut_before_the_shuffle(spark):
    df = spark.range(20).selectExpr("id % 3 as g", "id as k")
    for text in (":2", "-2:"):
        assert "WindowGroupLimit" in rows.select_rows(df, "k", text, by=["g"])._jdf.queryExecution().executedPlan().toString()


def test_positions_across_partitions(spark):
    df = spark.range(10_000).withColumn("x", (F.col("id") * 7919 % 10_007))
    got = positions.with_positions(df, "x", "i", "n").select("x", "i", "n").collect()
    assert [(r.i, r.n) for r in sorted(got, key=lambda r: r.x)] == [(i, 10_000) for i in range(10_000)]


def test_unique_orders(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    positions.require_unique(df, ["a", "b"])
    with pytest.raises(positions.OrderError):
        positions.require_unique(df, "a")


def test_named_forms(table):
    assert [r.k for r in rows.head(table, "k", 2).collect()] == [0, 1]
    assert [r.k for r in rows.offset(table, "k", 10).collect()] == [10, 11]
    assert [r.k for r in rows.tail(table, "k", 2).collect()] == [10, 11]
    assert rows.tail(table, "k", 0).count() == 0
    assert [r.k for r in rows.drop_last(table, "k", 10).collect()] == [0, 1]
    assert [r.k for r in rows.every(table, "k", 5).collect()] == [0, 5, 10]
    assert [r.k for r in rows.reverse(table, "k", 5).collect()] == [11, 6, 1]


TAKEN = ["place", "rows", "other_row", "row_of_group", "rows_of_group", "salt", "row_of_salt", "part_of_row", "place_in_part", "start_of_part", "rows_in_all", "rows_of_part", "Place_In_All", "first_of_group", "group_0", "__pos", "__n", "__row"]


@pytest.mark.parametrize("text, top", [("::2", 100_000), ("2:-2", 2), ("-3:", 100_000), ("1:4", 100_000), ("::-1", 2)])
def test_no_column_of_the_caller_is_lost(spark, text, top, monkeypatch):
    monkeypatch.setattr(rows, "TOP", top)
    df = spark.createDataFrame([(k, k % 2, *(f"{n}{k}" for n in TAKEN)) for k in range(9)], ["k", "g", *TAKEN])
    for options in ({}, {"position": "pos"}, {"position": "place_"}, {"by": ["g"]}, {"by": ["g"], "skewed": True, "position": "row_of_group_"}):
        out = rows.select_rows(df, "k", text, **options)
        assert out.columns == [*df.columns, *([options["position"]] if "position" in options else [])]
        for r in out.collect():
            assert all(r[n] == f"{n}{r.k}" for n in TAKEN) and r.g == r.k % 2


def test_ties_are_found_on_demand(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1)], "a int, b int, k0 int")
    assert rows.select_rows(df, ["a", "b"], ":2", unique=True).count() == 2
    assert rows.select_rows(df, "a", ":2", by=["b"], unique=True).count() == 3
    with pytest.raises(positions.OrderError, match="same a"):
        rows.select_rows(df, "a", ":2", unique=True)


def test_a_head_of_very_many_partitions_is_cut_twice(spark, monkeypatch):
    monkeypatch.setattr(rows, "TOP_SENT", 10)
    df = spark.range(5000).selectExpr("id * 7919 % 5003 as k", "id as salt").repartition(40)
    want = sorted(r.k for r in df.collect())
    for text, chosen in ((":7", want[:7]), ("-6:", want[-6:]), ("2:9:3", want[2:9:3]), ("::-1", want[::-1]), ("1005:1010", want[1005:1010])):
        out = rows.select_rows(df, "k", text)
        assert out.columns == ["k", "salt"] and [r.k for r in out.collect()] == chosen
    assert "WindowGroupLimit" in rows.select_rows(df, "k", ":7")._jdf.queryExecution().executedPlan().toString()


def test_positions_replace_columns_of_their_name(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "b", "y")], "k int, i string, n string")
    assert sorted(tuple(r) for r in positions.with_positions(df, "k", "i", "n").collect()) == [(1, 0, 2), (3, 1, 2)]
