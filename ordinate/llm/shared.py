"""What the operators share: the folder for tables between steps, word and white-space rules, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.names import free_name
from ordinate.session import delete, removed, shared_path, ship, stored, task_count

__all__ = ["SPACE", "WORD", "delete", "free_name", "integral", "removed", "shared_path", "ship", "small_or_shuffled", "stored", "task_count", "text_or_empty"]

#: White space and words of the contracts: ASCII only.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table of one narrow row each is sent to every executor (some 10 MB).
BROADCAST_ROWS = 200_000


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (stored, narrow), marked for broadcast if it was counted to be small; else Spark shuffles the join and splits its skew."""
    return F.broadcast(df) if df.count() <= rows else df


def integral(df: DataFrame, column: str) -> None:
    """Raise unless the column holds whole numbers: identifiers are compared and sent as such."""
    kind = dict(df.dtypes)[column]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"identifiers in {column} are {kind}; number them first")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))

