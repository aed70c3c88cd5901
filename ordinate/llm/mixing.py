"""Mixing sources to target weights, in DataFrame functions only.

Words are summed per source, a source's repetition rate is its target over its size, and each document is emitted
floor(rate) times plus one copy more if a hash of its identifier and the seed falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinate.llm.shared import WORD, free_name, small_or_shuffled, stored, text_or_empty
from ordinate.operators.positions import with_positions

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17


def words(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint")


def coin(id_col: str, seed: int = SEED) -> Column:
    """Uniform in [0, 1), the same for an identifier in every run: 52 bits of an MD5."""
    bits = F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return F.conv(bits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row a source, of any number of sources.

    Sources in code point order, null last, take the weights in turn. Targets share the total by weight and stop at cap
    times the source's size, the excess being reshared by weight among the others until none is above: each round is one
    sum over the sources, and a source that is full stays so.
    """
    per_source = stored(sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size")), "source-sizes")
    ordered = with_positions(per_source, F.col("source").asc_nulls_last(), "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    t = stored(ordered.select("source", "source_size", weight.alias("weight")), "source-weights")
    all_of = t.agg(F.coalesce(F.sum("source_size"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    used, gone, most = 0.0, 0.0, F.col("source_size") * cap
    while True:
        left, weight_left = all_of["total"] - used, all_of["weight"] - gone
        share = F.col("weight") * F.lit(left) / F.lit(weight_left) if weight_left else F.lit(0.0)
        full = most <= share
        filled = t.where(full).agg(F.coalesce(F.sum(most), F.lit(0.0)).alias("used"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("gone")).first()
        if (filled["used"], filled["gone"]) == (used, gone) or not weight_left:
            break
        used, gone = filled["used"], filled["gone"]
    return t.select("source", F.col("source_size").cast("bigint").alias("source_size"), F.when(full, most).otherwise(share).alias("target"))


def copies(size: Column, source_size: Column, target: Column, toss: Column) -> Column:
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(toss < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (its words times the copies that the mix takes).

    Null texts have no words; a null source is a source of its own, last in order; a null identifier has a coin of its
    own value. Rows that repeat an identifier share its coin. A source without words has target 0 and gives nothing. A long
    text is counted whole and, like any, taken whole or not at all. An empty table gives no rows; other columns are not read.
    """
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size")), "mix-sizes")
    targets = stored(source_targets(rows), "mix-targets").withColumnRenamed("source", "of")
    n = copies(F.col("size"), F.col("source_size"), F.col("target"), coin("doc_id"))
    return rows.join(small_or_shuffled(targets), F.col("source").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, all columns, each as many times as the mix takes it; nulls, empty texts and repeats as in mix_sizes()."""
    source, size, target, n, copy = (free_name(docs, x) for x in ("mix_source", "mix_size", "mix_target", "mix_copies", "mix_copy"))
    targets = stored(source_targets(docs.select(F.col(source_col).alias("source"), words(text_col).alias("size"))), "mix-targets").toDF(source, size, target)
    taken = docs.join(small_or_shuffled(targets), F.col(source_col).eqNullSafe(F.col(source)), "left").withColumn(n, copies(F.lit(0), F.col(size), F.col(target), coin(id_col))).where(F.col(n) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(source, size, target, n, copy)
