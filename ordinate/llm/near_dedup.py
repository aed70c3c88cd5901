"""Near-duplicate texts by BagMinHash: signatures of weighted sets whose agreement is an unbiased estimate of their weighted
Jaccard similarity, bands of the signatures as buckets, and a check of the multisets of word shingles.

Texts of the same words are one text. In each bucket every text is first held against one only, the one that shares most
buckets with others, which ties most of a large group together. Where a bucket then still has texts of several components,
those outside its largest component are held against all texts of other components, in blocks of bounded size: pairs whose
signatures agree, and whose runs that no other text has leave room for the similarity, are checked there on their runs, and
a block gives a spanning forest of the links that it finds, not every link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinate.llm.graph import components
from ordinate.llm.shared import WORD, free_name, integral, removed, ship, small_or_shuffled, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5  # at similarity 0.8 a pair shares no bucket with probability 3e-6
REGISTERS = BANDS * ROWS
#: Share of registers below which a pair is not checked: five standard deviations under the similarity.
AGREE = 0.64
#: Texts of a block of a bucket, and runs of words in it.
BLOCK = 256
BLOCK_RUNS = 1_000_000
#: Pairs of a centre that a task checks.
PAIRS = 512

MIX1, MIX2, MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WORDS = re.compile(WORD)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs, equal outputs, else as good as random."""
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    return x ^ (x >> np.uint64(31))


def shingles(text: str, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the runs of k words; fewer words than k are one run, no words none."""
    digest = xxhash.xxh3_64_intdigest
    words = np.array([digest(w) for w in WORDS.findall(text)], dtype=np.uint64)
    if not len(words):
        return words, np.zeros(0, dtype=np.int64)
    n = max(1, len(words) - k + 1)
    with np.errstate(over="ignore"):
        runs = np.full(n, np.uint64(len(words[:k])))
        for j in range(min(k, len(words))):
            runs = mix(runs * MIX1 + words[j:j + n])
    return np.unique(runs, return_counts=True)


def signature(items: np.ndarray, counts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """BagMinHash of a multiset.

    The weights of an item are split into the levels [0, 1), [1, 2), [2, 4), [4, 8), ... Each level is a Poisson process of
    points (time, register, weight) whose rate is the level's width, the same for an item in every multiset. A point counts
    if its weight is below the item's count; a register holds the first point that counts. Points are drawn in rounds, as
    far as the time at which the last register is filled.
    """
    if not len(items):
        return np.zeros(m, dtype=np.uint32)
    seeds, rates, floors, limits = [items], [np.ones(len(items))], [np.zeros(len(items))], [counts.astype(float)]
    level, low = 1, 1
    with np.errstate(over="ignore"):
        most = counts.max()
        while most > low:
            more = counts > low
            seeds.append(mix(items[more] + np.uint64(level) * MIX1))
            for held, value in ((rates, float(low)), (floors, float(low))):
                held.append(np.full(int(more.sum()), value))
            limits.append(counts[more].astype(float))
            level, low = level + 1, low * 2
        seed, rate, floor, limit = map(np.concatenate, (seeds, rates, floors, limits))
        first, point = np.full(m, np.inf), np.zeros(m, dtype=np.uint64)
        time, drawn = np.zeros(len(seed)), 0
        expected = m * (np.log(m) + 1)
        while len(seed):
            steps = int(min(64, expected / max(1.0, rate.sum()) + 2))
            number = np.arange(drawn, drawn + steps, dtype=np.uint64)
            h = mix(seed[:, None] + (number + np.uint64(1))[None, :] * MIX1)
            g = mix(h ^ MIX2)
            times = time[:, None] + np.cumsum(-np.log(((h >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / rate[:, None], axis=1)
            weight = floor[:, None] + rate[:, None] * ((g >> np.uint64(11)).astype(float) / (1 << 53))
            counting = weight < limit[:, None]
            register = (mix(g) % np.uint64(m)).astype(np.int64)
            t, r, p = times[counting], register[counting], h[counting]
            was = first.copy()
            np.minimum.at(first, r, t)
            new = (t == first[r]) & (t < was[r])
            point[r[new]] = p[new]
            last = times[:, -1]
            going = last < first.max()
            seed, rate, floor, limit, time, drawn = seed[going], rate[going], floor[going], limit[going], last[going], drawn + steps
    return (mix(point) >> np.uint64(32)).astype(np.uint32)


def bands(signatures: np.ndarray) -> np.ndarray:
    """A key for each band of each signature (a row)."""
    with np.errstate(over="ignore"):
        cut = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX1, cut.shape[:2])
        for k in range(ROWS):
            key = mix(key * MIX1 + cut[:, :, k])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset overlap of shingles(): the sum of the smaller counts over that of the larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 1.0


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h1, h2, signature, runs): runs is the number of shingles; h1 and h2 are the same for texts of the same words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                h1, h2, signatures, runs = [], [], [], []
                for value in part.column(1):
                    text = (value.as_py() or b"").decode("utf-8", "replace")
                    whole = xxhash.xxh3_128_digest(" ".join(WORDS.findall(text)))
                    h1.append(int.from_bytes(whole[:8], "big", signed=True))
                    h2.append(int.from_bytes(whole[8:], "big", signed=True))
                    items, counts = shingles(text)
                    signatures.append(signature(items, counts).tobytes())
                    runs.append(int(counts.sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(signatures, pa.binary()), pa.array(runs, pa.int64())], names=["id", "h1", "h2", "signature", "runs"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id bigint, h1 bigint, h2 bigint, signature binary, runs bigint")


def banded(texts: DataFrame) -> DataFrame:
    """(key, id) of each band of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bands(table(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), BANDS))], names=["key", "id"])

    return texts.select("id", "signature").mapInArrow(run, "key bigint, id bigint")


def table(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in signatures), dtype=np.uint32).reshape(len(signatures), REGISTERS)


def agreeing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = (table(batch.column(2)) == table(batch.column(3))).mean(axis=1) >= AGREE
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), batch.column(1).filter(pa.array(kept))], names=["a", "b"])

    s = texts.select("id", "signature")
    both = pairs.join(s.toDF("b", "signature_b"), "b").join(s.toDF("a", "signature_a"), "a")
    return both.select("a", "b", "signature_a", "signature_b").mapInArrow(run, "a bigint, b bigint").distinct()


def alike(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity. A pair's a is a centre of many: its text goes once with every PAIRS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, []
        for batch in batches:
            a, b = [], []
            for of, place, id_, text in zip(*(batch.column(k) for k in (0, 1, 2, 3))):
                key = of.as_py(), place.as_py()
                if key != now:
                    now, centre = key, []
                found = shingles((text.as_py() or b"").decode("utf-8", "replace"))
                if id_.is_valid and any(similarity(c, found) >= SIMILARITY for c in centre):
                    a.append(key[0])
                    b.append(id_.as_py())
                elif not id_.is_valid:
                    centre.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    texts = _texts(docs, id_col, text_col).join(small_or_shuffled(wanted), "id")
    centres = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts")), "parts")
    # A centre's row has no id of its own and comes first: nulls sort before all.
    of_centre = texts.join(small_or_shuffled(centres), F.col("id") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("place"), F.lit(None).cast("bigint").alias("id"), "text")
    other = pairs.join(small_or_shuffled(centres), "a").withColumn("place", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).join(texts, F.col("b") == F.col("id")).select("a", "place", "id", "text")
    both = of_centre.unionByName(other).repartition("a", "place").sortWithinPartitions("a", "place", "id")
    out = stored(both.mapInArrow(run, "a bigint, b bigint").distinct(), "links")
    removed(wanted, centres)
    return out


def common_runs(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, own): how many of its runs each of the texts has that no other one of them has; texts without such are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [shingles((v.as_py() or b"").decode("utf-8", "replace")) for v in part.column(1)]
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column(0)), sizes)), pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), pa.array(np.concatenate([f[1] for f in found]))], names=["id", "item", "n"])

    texts = _texts(docs, id_col, text_col).join(small_or_shuffled(ids), "id")
    alone = texts.mapInArrow(run, "id bigint, item bigint, n bigint").groupBy("item").agg(F.min("id").alias("id"), F.max("id").alias("other"), F.min("n").alias("n")).where("id = other")
    return alone.groupBy("id").agg(F.sum("n").alias("own"))


def _runs(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, items, counts) of shingles() of the texts, as bytes; counts are empty if all are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles((v.as_py() or b"").decode("utf-8", "replace")) for v in batch.column(1)]
            counts = [b"" if (c == 1).all() else c.astype(np.int32).tobytes() for _, c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array(counts, pa.binary())], names=["id", "items", "counts"])

    texts = _texts(docs, id_col, text_col).join(small_or_shuffled(ids), "id")
    return texts.mapInArrow(run, "id bigint, items binary, counts binary").dropDuplicates(["id"])


def blocks_left(buckets: DataFrame, groups: DataFrame, texts: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that tie components of a bucket together, of buckets of three texts or more.

    A bucket's texts are its largest component's and others. Blocks of others meet all blocks, so a text of the largest
    component is copied once for each block of others, never for one of its own. Of x runs and y runs with at most m in
    common a similarity is at most m / (x + y - m), and a text's own runs are not in common with any: a text whose own
    runs are over a fifth has no partner and drops out. A pair is looked at in the first of the buckets that it shares.
    """
    member = buckets.where("n > 2").select("key", "id").join(small_or_shuffled(groups.withColumnRenamed("node", "id")), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    member = stored(member, "members")
    open_keys = stored(member.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key"), "open")
    member = stored(member.join(small_or_shuffled(open_keys), "key"), "members")
    ids = stored(member.select("id").distinct(), "ids")
    own = stored(common_runs(ids, docs, id_col, text_col), "own-runs")
    room = texts.join(small_or_shuffled(ids), "id").join(small_or_shuffled(own), "id", "left").select("id", "signature", "runs", (F.col("runs") - F.coalesce("own", F.lit(0))).alias("common"))
    room = stored(room.where(F.col("common") >= SIMILARITY * F.col("runs")), "room")
    member = stored(member.join(small_or_shuffled(room.select("id", "runs")), "id"), "members")
    sizes = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("runs").alias("runs"))
    open_keys = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.sum("runs").alias("runs"), F.max(F.struct("n", "component", "runs")).alias("most")).where("n > most.n")
    blocks = lambda n, runs: F.greatest(F.ceil(n / BLOCK), F.ceil(runs / BLOCK_RUNS)).cast("int")
    most = F.col("most")
    open_keys = stored(open_keys.select("key", most["component"].alias("largest"), blocks(most["n"], most["runs"]).alias("own"), blocks(F.col("n") - most["n"], F.col("runs") - most["runs"]).alias("others")), "open")
    rows = member.drop("runs").join(small_or_shuffled(open_keys), "key")
    other = F.col("component") != F.col("largest")
    place = F.pmod(F.xxhash64("id"), F.when(other, F.col("others")).otherwise(F.col("own"))).cast("int")
    rows = rows.withColumns({"other": other, "place": place})
    # Block pairs: (other i, other j) with i <= j as (i, j), (other i, own j) as (i, -1 - j).
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: F.struct(F.least(k, F.col("place")).alias("i"), F.greatest(k, F.col("place")).alias("j")))
    against = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda k: F.struct(F.col("place").alias("i"), (-1 - k).alias("j")))
    copies = F.when(F.col("other"), F.concat(among, against)).otherwise(F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: F.struct(k.alias("i"), (-1 - F.col("place")).alias("j"))))
    dealt = rows.withColumn("at", F.explode(copies)).select("key", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "id", "component", "other", "place")
    content = stored(room.join(_runs(stored(rows.select("id").distinct(), "ids"), docs, id_col, text_col), "id"), "contents")
    dealt = dealt.join(content, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def meet(rows: pa.Table) -> list[tuple[int, int]]:
        ids, label = (np.array(rows.column(c).combine_chunks()) for c in ("id", "component"))
        other, place, runs, common = (rows.column(c).to_numpy() for c in ("other", "place", "runs", "common"))
        key, i, j = (rows.column(c)[0].as_py() for c in ("key", "i", "j"))
        left = np.flatnonzero(other & (place == i))
        right = np.flatnonzero(~other) if j < 0 else np.flatnonzero(other & (place == j))
        s = table(rows.column("signature").combine_chunks())
        band = int(np.flatnonzero(bands(s[:1])[0] == key)[0])
        items, counts = rows.column("items"), rows.column("counts")
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def content(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in held:
                x = np.frombuffer(items[k].as_py(), dtype=np.uint64)
                held[k] = x, np.frombuffer(counts[k].as_py(), dtype=np.int32) if counts[k].as_py() else np.ones(len(x), dtype=np.int32)
            return held[k]

        links = []
        for x in left:
            y = right[label[right] != label[x]]
            most = np.minimum(common[x], common[y])
            y = y[most >= SIMILARITY * (runs[x] + runs[y] - most)]
            same = s[y] == s[x]
            new = ~same[:, :band * ROWS].reshape(len(y), band, ROWS).all(axis=2).any(axis=1)
            agree = same.mean(axis=1)
            near = np.flatnonzero(new & (agree >= AGREE))
            for z in y[near[np.argsort(-agree[near], kind="stable")]]:
                if label[z] != label[x] and similarity(content(x), content(z)) >= SIMILARITY:
                    links.append((int(ids[x]), int(ids[z])))
                    label[label == label[z]] = label[x]
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            links = meet(pa.Table.from_batches(held)) if held else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(3)], axis=1)
            starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for s, e in zip(starts, starts[1:]):
                if (key := tuple(marks[s])) != now:
                    yield from done()
                    held, now = [], key
                held.append(batch.slice(s, e - s))
        yield from done()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, component_id (smallest doc_id reachable by links), kept (whether that is its own).

    Texts are linked if the multisets of their runs of five words have a weighted Jaccard similarity of 0.8 or more; fewer
    words are one run. Null texts count as empty, and texts without words are alike. Rows that repeat an identifier are one
    document, linked by any of its texts; a null identifier is linked with nothing and kept. Identifiers are whole numbers:
    others raise TypeError. A text of any length is one value of one task, with 16 bytes a run of words. An empty table
    gives no rows; other columns are not read.

    A pair of similarity 0.8 is missed with a probability of about 3e-6 (it shares no bucket) and 1.4e-6 (its signatures agree
    in less than AGREE), the more alike the less.
    """
    ship(docs.sparkSession)
    integral(docs, id_col)
    every = stored(signed(docs, id_col, text_col), "signatures")
    same = stored(every.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "same-words")
    copies = stored(every.select("id", "h1", "h2").join(small_or_shuffled(same), ["h1", "h2"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), "copies")
    texts = stored(every.select("id", "signature", "runs").join(small_or_shuffled(copies.select(F.col("a").alias("id")).distinct()), "id", "left_anti"), "texts")
    removed(every, same)
    keyed = banded(texts)
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    buckets = stored(keyed.join(small_or_shuffled(shared), "key"), "bucket-members")
    neighbours = stored(buckets.groupBy("id").agg(F.sum("n").alias("near")), "neighbours")
    best = F.max(F.struct(F.col("near"), (-F.col("id")).alias("rank"))).alias("best")
    centres = stored(buckets.join(small_or_shuffled(neighbours), "id").groupBy("key").agg(best).select("key", (-F.col("best.rank")).alias("centre")), "centres")
    tried = buckets.join(small_or_shuffled(centres), "key").where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    tried = stored(agreeing(tried, texts), "pairs")
    removed(shared, neighbours, centres)
    stars = alike(tried, docs, id_col, text_col)
    left = stored(blocks_left(buckets, stored(components(stars.toDF("u", "v")), "groups"), texts, docs, id_col, text_col), "links")
    removed(buckets, texts, tried)
    groups = stored(components(stars.unionByName(left).unionByName(copies).toDF("u", "v")), "groups")
    rows = docs.select(F.col(id_col).alias("doc_id"))
    component = F.coalesce("component", "doc_id")
    return rows.join(small_or_shuffled(groups), F.col("doc_id") == F.col("node"), "left").select("doc_id", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are the smallest of their component; nulls, empty texts and repeats as in near_groups()."""
    name = free_name(docs, "gone")
    gone = stored(near_groups(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(small_or_shuffled(gone), F.col(id_col) == F.col(name), "left_anti")
