"""Exact dedup by a content sort, in DataFrame functions only.

Sampled splitters range-partition the normalised texts, an external sort places equal texts side by side, and a sorted
aggregation compares each text with its neighbour in full and retains the smallest identifier.

The range key is a bounded piece of the text and its hash, so that splitters stay small however long texts are. A text
that more than a quarter of a mean partition's rows share is salted by identifier (at most four such texts a partition,
hence the bound on what is broadcast) and its parts meet again as one row a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinate.llm.shared import SPACE, free_name, removed, small_or_shuffled, stored, task_count, text_or_empty

PREFIX_CHARS = 32


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, hash) of each row, stored."""
    norm = normalised(text_col)
    return stored(docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.xxhash64("norm").alias("hash")), "text-marks")


def equal_groups(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_sha256, keep_id, group_size) of each text that several rows share, by the content sort; marked is marks() of docs."""
    parts = task_count(docs)
    limit = max(1, marked.count() // (4 * parts))
    hot = marked.groupBy("hash").count().where(F.col("count") > limit).select("hash", F.lit(True).alias("hot"))
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).withColumn("hash", F.xxhash64("norm"))
    salted = rows.join(F.broadcast(hot), "hash", "left").select(
        "id", "norm", "hash",
        F.substring("norm", 1, PREFIX_CHARS).alias("prefix"),
        F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(F.lit(-1)).alias("salt"),
    )
    # An aggregate of strings keeps Spark from hashing: it sorts by the whole key and compares neighbours.
    runs = salted.repartitionByRange(parts, "prefix", "hash", "salt").groupBy("prefix", "hash", "salt", "norm").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.min("norm").alias("text"))
    several = runs.where("n > 1 or salt >= 0").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "n")
    return several.groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1")


def exact_dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. A null identifier is never the smallest unless its group has no other; rows that repeat the
    smallest identifier of their group are all marked kept, since nothing tells them apart. Identifiers may be of any type
    with an order. Long texts are sorted whole but sampled by their beginning and hash. An empty table gives no rows; other
    columns are not read.
    """
    rows = marks(docs, id_col, text_col)
    groups = stored(equal_groups(docs, rows, id_col, text_col), "equal-texts")
    size = F.coalesce("group_size", F.lit(1).cast("bigint"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(small_or_shuffled(groups), "text_sha256", "left").select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those whose text a smaller identifier has.

    Nulls, empty texts and repeated identifiers as in exact_dedup_groups(): rows that repeat the smallest one all stay.
    """
    marked = marks(docs, id_col, text_col)
    groups = stored(equal_groups(docs, marked, id_col, text_col), "equal-texts")
    removed(marked)
    sha, keep, shared = (free_name(docs, n) for n in ("text_sha", "keep", "shared"))
    other = small_or_shuffled(groups.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep), F.lit(True).alias(shared)))
    joined = docs.withColumn(sha, F.sha2(normalised(text_col), 256)).join(other, sha, "left")
    return joined.where(F.col(shared).isNull() | F.col(id_col).eqNullSafe(F.col(keep))).drop(sha, keep, shared)
