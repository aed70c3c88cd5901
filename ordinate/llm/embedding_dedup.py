"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are projected on leading principal dimensions and sorted by the grid cells they fall into, cells being as
wide as the distance that the cosine allows. The sorted sequence is cut into intervals, which are the leaves of a tree;
pairs of intervals are joined recursively from the root down, and a pair whose boxes lie further apart than that distance
in the projection, hence in full, is skipped. What pairs of leaves are left go to tasks, which go on halving them.

A place in the projection has one coordinate more: the length of what the projection leaves out. So places are unit vectors
too, and the product of two places is never less than the cosine of their vectors. Blocks that boxes cannot tell apart are
multiplied in the projection first, and only pairs whose places are within reach are compared in full. As many axes are
taken as leave few distant pairs of a sample within reach: data without leading dimensions take more of them.

Equal vectors are one vector with a number of copies. Tasks give counts of links and a spanning forest of them, not the
links, so that a large group of near copies costs no more output than its size. Vectors of different lengths never link:
the length is the first key of the order, and no leaf holds two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordinate.llm.graph import components
from ordinate.llm.shared import free_name, integral, ship, small_or_shuffled, stored

#: Vectors, and components of them in all, that the principal dimensions are fitted on; any orthonormal directions give the same result.
SAMPLE = 4000
SAMPLE_VALUES = 1 << 20
#: Most axes, how many are added at a time, and the share of distant pairs of the sample that they may leave within reach.
AXES = 32
MORE_AXES = 4
WITHIN_REACH = 1e-3
#: Vectors and bytes of an interval of the sequence, and vectors of a block, below which a task stops halving.
LEAF = 8192
LEAF_BYTES = 4 << 20
LEAST = 256
FAN = 16
#: Places are of single precision: their products are off by less than this.
SLACK = 1e-5


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that neither large nor small components overflow."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def usable(name: str) -> Column:
    """Neither null nor zero, and no null or non-finite component."""
    v = F.col(name)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def places(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors in the projection and the length of the rest; axes are cut or taken as zero beyond the vectors' length."""
    n = min(x.shape[1], len(axes))
    p = x[:, :n] @ axes[:n]
    return np.column_stack([p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(axis=1)))])


def directions(vectors: DataFrame, similarity: float) -> np.ndarray:
    """Orthonormal leading principal directions of a bounded sample of vectors of one length, taken by a hash of the vector."""
    known = vectors.agg(F.count(F.lit(1)).alias("n"), F.mode("dim", True).alias("dim")).first()
    wanted = max(2, min(SAMPLE, SAMPLE_VALUES // known["dim"]))
    every = max(1, known["n"] // wanted)
    rows = vectors.where((F.col("dim") == known["dim"]) & (F.pmod("h2", F.lit(every)) == 0)).select("v").limit(wanted).toArrow()
    if not rows.num_rows:
        return np.eye(known["dim"], 1)
    x = unit(matrix(rows.column(0).combine_chunks()))
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    some = x[:1000]
    distant = some @ some.T < similarity
    for k in range(MORE_AXES, AXES, MORE_AXES):
        place = places(some, axes[:k].T)
        if ((place @ place.T >= similarity) & distant).sum() <= WITHIN_REACH * max(1, distant.sum()):
            return axes[:k].T.copy()
    return axes[:AXES].T.copy()


def grid(vectors: DataFrame, axes: np.ndarray, radius: float) -> DataFrame:
    """vectors with their grid cell and place in the projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                place = places(unit(matrix(part.column(3))), axes)
                cell = np.floor(place / radius).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(cell), pa.list_(pa.int32())), pa.array(list(place.astype(np.float32)), pa.list_(pa.float32()))], names=["dim", "id", "number", "v", "copies", "cell", "place"])

    kind = dict(vectors.dtypes)
    return vectors.select("dim", "id", "number", "v", "copies").mapInArrow(run, f"dim int, id bigint, number bigint, v {kind['v']}, copies bigint, cell array<int>, place array<float>")


def intervals(rows: DataFrame, n: int) -> DataFrame:
    """The sorted sequence cut into leaves: part, leaf (of its part), box, and the vectors. The length is a box's first side."""
    parts = max(1, -(-n // LEAF))
    ordered = rows.repartitionByRange(parts, "dim", "cell", "place", "number").sortWithinPartitions("dim", "cell", "place", "number")
    kind = dict(rows.dtypes)
    size = 8 if "double" in kind["v"] else 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, leaf, held, dim = TaskContext.get().partitionId(), 0, [], -1

        def leaves(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, leaf
            most = max(1, min(LEAF, LEAF_BYTES // (size * max(1, dim))))
            while (n := sum(b.num_rows for b in held)) >= most or whole and n:
                t = pa.Table.from_batches(held).combine_chunks()
                one, rest = t.slice(0, most), t.slice(most)
                place = matrix(one.column("place").combine_chunks())
                low, high = (np.concatenate([[10.0 * dim], f(place, axis=0)]) for f in (np.min, np.max))
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int32()), pa.array([leaf], pa.int32()), pa.array([low.tolist()], pa.list_(pa.float64())), pa.array([high.tolist()], pa.list_(pa.float64())),
                    *(pa.array([one.column(c).to_pylist()], pa.list_(one.schema.field(c).type)) for c in ("id", "number", "copies")),
                    pa.array([np.ascontiguousarray(matrix(one.column("v").combine_chunks())).tobytes()], pa.binary()), pa.array([place.tobytes()], pa.binary()),
                ], names=["part", "leaf", "low", "high", "ids", "numbers", "copies", "v", "place"])
                held, leaf = rest.to_batches(), leaf + 1

        for batch in batches:
            dims = np.asarray(batch.column(0))
            starts = [*np.flatnonzero(np.diff(dims, prepend=-1)).tolist(), len(dims)]
            for a, b in zip(starts, starts[1:]):
                if dims[a] != dim:
                    yield from leaves(True)
                    dim = int(dims[a])
                held.append(batch.slice(a, b - a))
                yield from leaves(False)
        yield from leaves(True)

    return ordered.mapInArrow(cut, "part int, leaf int, low array<double>, high array<double>, ids array<bigint>, numbers array<bigint>, copies array<bigint>, v binary, place binary")


def numbered(leaves: DataFrame) -> DataFrame:
    """leaves with their number in the sequence. There is one row a leaf, and parts are counted, not gathered."""
    counts = leaves.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return leaves.join(small_or_shuffled(starts), "part").withColumn("node", (F.col("start") + F.col("leaf")).cast("bigint")).drop("start", "part", "leaf")


def apart(low: str, high: str, other_low: str, other_high: str) -> Column:
    """Squared distance of two boxes."""
    gap = F.zip_with(F.zip_with(F.col(low), F.col(other_high), lambda a, b: a - b), F.zip_with(F.col(other_low), F.col(high), lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)


def near_leaves(leaves: DataFrame, sides: int, radius: float) -> DataFrame:
    """(a, b) of the leaves whose boxes are within the radius, from the root of the tree down; each pair once."""
    boxes = stored(leaves.select("node", "low", "high"), "boxes")
    levels, n = [boxes], boxes.count()
    while n > 1:
        up = levels[-1].groupBy((F.col("node") / FAN).cast("bigint").alias("node")).agg(
            F.array(*[F.min(F.col("low")[k]) for k in range(sides)]).alias("low"), F.array(*[F.max(F.col("high")[k]) for k in range(sides)]).alias("high"))
        levels.append(stored(up, "boxes"))
        n = -(-n // FAN)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    child = F.explode(F.sequence(F.lit(0), F.lit(FAN - 1)))
    for level in reversed(levels[:-1]):
        finer = pairs.withColumn("k", child).withColumn("a", F.col("a") * FAN + F.col("k")).withColumn("k", child).withColumn("b", F.col("b") * FAN + F.col("k")).where("a <= b").drop("k")
        one = small_or_shuffled(level.toDF("a", "low_a", "high_a"))
        two = small_or_shuffled(level.toDF("b", "low_b", "high_b"))
        pairs = stored(finer.join(one, "a").join(two, "b").where(apart("low_a", "high_a", "low_b", "high_b") <= radius * radius).select("a", "b"), "pairs")
    # Every leaf stands about as often on either side, so that no task gets the pairs of all.
    turned = (F.col("a") + F.col("b")) % 2 == 1
    return pairs.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))


class Joiner:
    """Links of two intervals, or of one with itself: counts of linked copies by vector and a spanning forest.

    pairs, screened and compared are how many pairs there are, how many were multiplied in the projection, and how many in full.
    """

    def __init__(self, x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, copies: np.ndarray, same: bool, least: float, radius: float):
        self.z = np.concatenate([x, y]) if not same else x
        self.p = np.concatenate([px, py]) if not same else px
        self.copies, self.least, self.radius = copies, least, radius
        self.label, self.links = np.arange(len(self.z)), np.zeros(len(self.z), dtype=np.int64)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.pairs, self.screened, self.compared = len(x) * (len(x) - 1) // 2 if same else len(x) * len(y), 0, 0
        self.join(0, len(x), *((0, len(x)) if same else (len(x), len(self.z))))

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.boxes.get((a, b))
        if found is None:
            found = self.boxes[a, b] = self.p[a:b].min(axis=0), self.p[a:b].max(axis=0)
        return found

    def join(self, a: int, b: int, c: int, d: int) -> None:
        if a >= b or c >= d:
            return
        if (a, b) != (c, d):
            (low, high), (other_low, other_high) = self.box(a, b), self.box(c, d)
            gap = np.maximum(0, np.maximum(low - other_high, other_low - high))
            if gap @ gap > self.radius * self.radius:
                return
        if max(b - a, d - c) <= LEAST:
            self.block(a, b, c, d)
            return
        m, n = (a + b) // 2, (c + d) // 2
        if (a, b) == (c, d):
            self.join(a, m, a, m)
            self.join(a, m, m, b)
            self.join(m, b, m, b)
            return
        for e, f in ((a, m), (m, b)) if b - a > LEAST else ((a, b),):
            for g, h in ((c, n), (n, d)) if d - c > LEAST else ((c, d),):
                self.join(e, f, g, h)

    def block(self, a: int, b: int, c: int, d: int) -> None:
        near = self.p[a:b] @ self.p[c:d].T >= self.least - SLACK
        if (a, b) == (c, d):
            near = np.triu(near, 1)
            self.screened += (b - a) * (b - a - 1) // 2
        else:
            self.screened += near.size
        found = int(np.count_nonzero(near))
        if not found:
            return
        if found > near.size // 16:
            near &= self.z[a:b] @ self.z[c:d].T >= self.least
            self.compared += near.size
            i, j = np.nonzero(near)
        else:
            i, j = np.nonzero(near)
            kept = np.einsum("ij,ij->i", self.z[a:b][i], self.z[c:d][j]) >= self.least
            self.compared += found
            i, j = i[kept], j[kept]
        if len(i):
            i, j = i + a, j + c
            n = len(self.z)
            self.links += np.bincount(i, self.copies[j], n).astype(np.int64) + np.bincount(j, self.copies[i], n).astype(np.int64)
            self.unite(i, j)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label[:] = label[label]


def linked(pairs: DataFrame, leaves: DataFrame, similarity: float, radius: float, kind: str) -> DataFrame:
    """(number, links, id, other): links found in a pair of leaves, and an edge of its forest to a row tied to it, if any."""
    rows = leaves.select("node", "ids", "numbers", "copies", "v", "place")
    named = lambda s: rows.toDF(s, f"ids_{s}", f"numbers_{s}", f"copies_{s}", f"v_{s}", f"place_{s}")
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    element = np.float64 if "double" in kind else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k] for n in batch.schema.names}
                same = r["a"].as_py() == r["b"].as_py()
                ids, numbers, copies = (np.asarray(r[f"{c}_a"].values if same else pa.concat_arrays([r[f"{c}_a"].values, r[f"{c}_b"].values])) for c in ("ids", "numbers", "copies"))
                x, y = (unit(np.frombuffer(r[f"v_{s}"].as_py(), dtype=element).reshape(len(r[f"ids_{s}"].values), -1)) for s in "ab")
                px, py = (np.frombuffer(r[f"place_{s}"].as_py(), dtype=np.float32).reshape(len(r[f"ids_{s}"].values), -1) for s in "ab")
                found = Joiner(x, px, y, py, copies, same, similarity, radius)
                at = np.flatnonzero(found.links)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (numbers[at], found.links[at], ids[at], ids[found.label[at]])], names=["number", "links", "id", "other"])

    return both.mapInArrow(run, "number bigint, links bigint, id bigint, other bigint")


def embedding_groups(vectors: DataFrame, similarity: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    A vector that is null, empty, zero, or holds null or non-finite components links with nothing. Vectors may be of any
    lengths; those of different lengths do not link, and long ones come in intervals of fewer rows. Rows that repeat an
    identifier count as vectors of their own with one identifier; a null identifier links with nothing. Identifiers are
    whole numbers: others raise TypeError. An empty table gives no rows; other columns are not read.
    """
    ship(vectors.sparkSession)
    integral(vectors, id_col)
    radius = float(np.sqrt(2 - 2 * similarity + 2 * SLACK))
    kind = dict(vectors.dtypes)[vector_col]
    keyed = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(usable(vector_col) & F.col(id_col).isNotNull(), F.col(vector_col)).alias("v")).withColumns(
        {"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), F.col("v")))})
    distinct = stored(keyed.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v")).withColumns({"dim": F.size("v"), "number": F.monotonically_increasing_id()}), "vectors")
    rows = keyed.select("vec_id", "h1", "h2")
    n = distinct.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes = directions(distinct, similarity)
    leaves = numbered(stored(intervals(grid(distinct, axes, radius), n), "leaves"))
    found = stored(linked(near_leaves(leaves, axes.shape[1] + 2, radius), leaves, similarity, radius, kind), "links")
    links = found.groupBy("number").agg(F.sum("links").alias("links"))
    groups = components(found.where("id <> other").select(F.col("id").alias("u"), F.col("other").alias("v")))
    of_vector = distinct.select("h1", "h2", "id", "number", "copies").join(links, "number", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").where("copies > 1 or links is not null or component is not null")
    of_vector = stored(of_vector.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component")), "vector-links")
    out = rows.join(small_or_shuffled(of_vector), ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def near_free(vectors: DataFrame, similarity: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The rows of vectors, all columns, that are the smallest of their component; nulls, lengths and repeats as in embedding_groups()."""
    gone = free_name(vectors, "gone")
    away = stored(embedding_groups(vectors, similarity, id_col, vector_col).where(~F.col("kept")).select(F.col("vec_id").alias(gone)), "gone")
    return vectors.join(small_or_shuffled(away), F.col(id_col) == F.col(gone), "left_anti")
