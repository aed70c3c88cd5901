"""Every registered query of the engine against its SQL, at the smallest scale."""

import os
from pathlib import Path

import duckdb
import pytest

from ordinate import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(str(r[k]) if not isinstance(r[k], float) else repr(r[k]) for k in order) for r in values))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, db, name):
    got = queries.QUERIES[name](spark, FOLDER)
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_engine_stands_without_the_other_subpackage():
    """Nothing outside the subpackage and its pipeline imports it."""
    top = Path(queries.__file__).parent
    for path in top.rglob("*.py"):
        if path.relative_to(top).parts[0] != "llm":
            assert "ordinate.llm" not in path.read_text(), path


def test_no_task_writes_all_lines_of_a_language(spark, db, monkeypatch):
    monkeypatch.setattr(queries, "LINES_BYTES", 30_000)
    inputs = queries.raw_lines(spark, FOLDER)
    assert len(inputs) == 4 and sum(len(i.paths) for i in inputs) > 8
    got = [b"".join(Path(p.removeprefix("file:")).read_bytes() for p in i.paths).decode() for i in inputs]
    assert got == [content for (content,) in db.execute(f"select content from ({queries.FILES_SQL}) order by file_no").fetchall()]
