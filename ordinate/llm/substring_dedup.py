"""Repeated passages removed by broadcast suffix automata of reference shards.

A reference is cut into shards of bounded size, each shard's suffix automaton is broadcast, and texts are streamed through
it for matching statistics; words under a match of the length are removed.

remove_known() has a list of texts for a reference. repeated_passages() holds a corpus against itself. Its reference is one
place of each window of 35 words that occurs again, and what is streamed through a shard is the text of all documents around
the windows that the shard has. Hashes only choose them:

A fingerprint is the hash of 18 words, and a window belongs to the smallest of its 18 fingerprints, so equal windows
belong to equal fingerprints. Neighbouring windows of one fingerprint are a region. Regions whose fingerprint occurs once
hold nothing repeated and drop out. Where all regions of a fingerprint are equal, one of them is taken into the reference;
else the hashes of its regions' windows tell which windows occur again, and one place of each is. Neighbouring windows of
the reference join up to spans, which are cut every PIECE words and dealt to shards by hash, so that no passage, however
often it occurs, makes a shard larger. Automata are built in tasks and broadcast SHARDS at a time, in as many rounds as the
distinct repeated text of the corpus fills; the text around a window goes through that window's shard only.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinate.llm.shared import delete, removed, shared_path, ship, small_or_shuffled, stored, task_count

LENGTH = 35
GRAM = 18
OWN = LENGTH - GRAM + 1  # fingerprints in a window, and most windows in a region

#: Words of a shard or so (its automaton has some 70 bytes a word), and shards of a round.
SHARD_WORDS = 30_000
SHARDS = 16
#: Words at which a span of the reference is cut, and of a piece of a text that remove_known() sends through an automaton.
PIECE = 512

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX2, MIX3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    return x ^ (x >> np.uint64(31))


def hashed(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


class Runs:
    """Hashes of runs of words, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def sums(self, words: np.ndarray) -> np.ndarray:
        n = len(words) + 1
        if n > len(self.up):
            size = max(n, min(2 * len(self.up), 1 << 20))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, np.uint64(self.base))]))
                self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, np.uint64(self.back))]))
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[:len(words)])])

    def at(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class SuffixAutomaton:
    """The substrings of several sequences of word hashes."""

    def __init__(self, sequences: Iterable[np.ndarray]):
        sequences = list(sequences)
        self.symbols = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *sequences]))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [0], [0]
        for sequence in sequences:
            last = 0
            for symbol in np.searchsorted(self.symbols, sequence).tolist():
                last = self._extend(last, symbol)
        # The edges as one sorted table, keyed by state and symbol.
        state = np.repeat(np.arange(len(self.next)), [len(edges) for edges in self.next])
        symbol = np.fromiter(chain.from_iterable(self.next), dtype=np.int64, count=len(state))
        to = np.fromiter(chain.from_iterable(edges.values() for edges in self.next), dtype=np.int32, count=len(state))
        key = state * len(self.symbols) + symbol
        order = np.argsort(key)
        self.key, self.to = key[order], to[order]
        self.link, self.length = np.array(self.link, dtype=np.int32), np.array(self.length, dtype=np.int32)
        del self.next

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, symbol: int) -> int:
        """The state one longer than `state` that `symbol` leads to, made out of a longer one if need be."""
        to = self.next[state][symbol]
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._state(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while self.next[state].get(symbol) == to:
            self.next[state][symbol] = copy
            if not state:
                break
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        new = self._state(self.length[last] + 1, 0, {})
        while symbol not in self.next[last]:
            self.next[last][symbol] = new
            if not last:
                return new
            last = self.link[last]
        self.link[new] = self._split(last, symbol)
        return new

    def matches(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """At each word of each sequence, the length of the longest match that ends there. Sequences go side by side."""
        sizes = np.array([len(x) for x in sequences], dtype=np.int64)
        out = [np.zeros(n, dtype=np.int32) for n in sizes]
        if not len(self.key) or not sizes.any():
            return out
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([sequences[k] for k in order])
        symbol = np.searchsorted(self.symbols, flat)
        symbol[symbol == len(self.symbols)] = 0
        known = self.symbols[symbol] == flat
        start = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
        state, depth = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int32)
        found = np.zeros(len(flat), dtype=np.int32)
        for t in range(int(sizes.max())):
            m = int(np.searchsorted(-sizes[order], -t))  # the sequences longer than t
            at = start[:m] + t
            lost = ~known[at]
            state[:m][lost] = 0
            depth[:m][lost] = 0
            todo = np.flatnonzero(~lost)
            while len(todo):
                key = state[todo] * len(self.symbols) + symbol[at[todo]]
                edge = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                hit = self.key[edge] == key
                went = todo[hit]
                state[went] = self.to[edge[hit]]
                depth[went] += 1
                todo = todo[~hit]
                root = state[todo] == 0
                depth[todo[root]] = 0
                todo = todo[~root]
                state[todo] = self.link[state[todo]]
                depth[todo] = self.length[state[todo]]
            found[at] = depth[:m]
        for k, s in zip(order, start):
            out[k] = found[s:s + sizes[k]]
        return out


# A corpus against itself.

def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b, text, doc_id): a and b, 128 bits, mark a text under its identifier, whatever the identifier's type, null included."""
    text = F.col(text_col).cast("string")
    return docs.select(F.xxhash64(F.col(id_col), text).alias("a"), F.xxhash64(F.lit(7), text, F.col(id_col)).alias("b"), text.cast("binary").alias("text"), F.col(id_col).alias("doc_id"))


def places(words: np.ndarray, grams: Runs, regions: Runs) -> tuple[np.ndarray, ...]:
    """(start, windows, fingerprint, region hash) of the regions of a text."""
    n = len(words) - LENGTH + 1
    if n < 1:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    sums, more = grams.sums(words), regions.sums(words)
    at = np.arange(len(words) - GRAM + 1)
    prints = grams.at(sums, at, at + GRAM)
    own = np.arange(n) + np.lib.stride_tricks.sliding_window_view(prints, OWN).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    windows = np.diff(np.append(first, n))
    return first, windows, prints[own[first]].view(np.int64), regions.at(more, first, first + windows + LENGTH - 1).view(np.int64)


def _places(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, regions = Runs(BASES[0]), Runs(BASES[1])
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = [places(hashed((v.as_py() or b"").split()), grams, regions) for v in part.column(2)]
                sizes = np.array([len(f[0]) for f in found])
                a, b = (np.repeat(np.asarray(part.column(c)), sizes) for c in (0, 1))
                start, windows, prints, region = (np.concatenate([f[c] for f in found]) for c in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int16)), pa.array(prints.astype(np.int64)), pa.array(region.astype(np.int64))], names=["a", "b", "start", "windows", "print", "region"])

    return docs.select("a", "b", "text").mapInArrow(run, "a bigint, b bigint, start int, windows smallint, print bigint, region bigint")


def _by_text(rows: DataFrame, columns: list[str], docs: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow(run) over (a, b, text, rows) of each text that rows (a, b, columns) name; a text that repeats comes once."""
    by_text = stored(rows.groupBy("a", "b").agg(F.collect_list(F.struct(*columns)).alias("rows")), "wanted")
    some = docs.join(small_or_shuffled(by_text.select("a", "b")), ["a", "b"], "left_semi").dropDuplicates(["a", "b"])
    out = stored(some.join(by_text, ["a", "b"]).select("a", "b", "text", "rows").mapInArrow(run, schema), "by-text")
    removed(by_text)
    return out


def _texts_and_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, pa.RecordBatch]]:
    """(a, b, word hashes, rows) of _by_text()."""
    for batch in batches:
        for k in range(batch.num_rows):
            words = hashed((batch.column(2)[k].as_py() or b"").split())
            yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), words, pa.RecordBatch.from_struct_array(batch.column(3)[k].values)


def _window_hashes(regions: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, start, print, region, n, windows) of each region, with the hashes of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(BASES[1])
        for a, b, words, rows in _texts_and_rows(batches):
            start, count = (np.asarray(rows.column(c)).astype(np.int64) for c in ("start", "windows"))
            ends = np.cumsum(count)
            at = np.arange(ends[-1]) + np.repeat(start - ends + count, count)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(runs.at(runs.sums(words), at, at + LENGTH).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([a] * len(start), pa.int64()), pa.array([b] * len(start), pa.int64()), *(rows.column(c) for c in ("start", "print", "region", "n")), lists], names=["a", "b", "start", "print", "region", "n", "windows"])

    return _by_text(regions, ["start", "windows", "print", "region", "n"], docs, run, "a bigint, b bigint, start int, print bigint, region bigint, n bigint, windows array<bigint>")


def runs_of(first: np.ndarray, count: np.ndarray, piece: int | None = None) -> list[tuple[int, int]]:
    """(first, end) of the runs of neighbouring windows that ranges of windows make up, cut at every `piece`."""
    n = int((first + count).max()) + 1
    edge = np.bincount(first, minlength=n + 1) - np.bincount(first + count, minlength=n + 1)
    there = np.cumsum(edge)[:n] > 0
    change = np.diff(there.astype(np.int8), prepend=0, append=0)
    if piece:
        cuts = np.arange(piece, n, piece)
        cuts = cuts[there[cuts] & there[cuts - 1]]
        starts, ends = np.sort(np.concatenate([np.flatnonzero(change == 1), cuts])), np.sort(np.concatenate([np.flatnonzero(change == -1), cuts]))
    else:
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    return list(zip(starts.tolist(), ends.tolist()))


def _spans(reference: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, piece, words) of the spans of a reference (a, b, first, count), cut into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, words, rows in _texts_and_rows(batches):
            found = runs_of(*(np.asarray(c).astype(np.int64) for c in rows.columns), PIECE)
            yield pa.RecordBatch.from_arrays([pa.array([a] * len(found), pa.int64()), pa.array([b] * len(found), pa.int64()), pa.array([s // PIECE for s, _ in found], pa.int32()), pa.array([words[s:e + LENGTH - 1].tobytes() for s, e in found], pa.binary())], names=["a", "b", "piece", "words"])

    return _by_text(reference, ["first", "count"], docs, run, "a bigint, b bigint, piece int, words binary")


def _automata(spans: DataFrame) -> DataFrame:
    """(shard, automaton, round) of spans (shard, words), each shard in one task."""

    def built(shard: int, sequences: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([pickle.dumps(SuffixAutomaton(sequences))], pa.binary()), pa.array([shard // SHARDS], pa.int64())], names=["shard", "automaton", "round"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and shard != now:
                    yield built(now, held)
                    held = []
                now = shard
                held.append(np.frombuffer(words.as_py(), dtype=np.uint64))
        if held:
            yield built(now, held)

    return spans.select("shard", "words").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard bigint, automaton binary, round bigint")


def _streams(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, shard, first, words): the text around the windows of found (a, b, start, shard, mask), by the shard that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, words, rows in _texts_and_rows(batches):
            start, shard, mask = (np.asarray(c).astype(np.int64) for c in rows.columns)
            row, k = np.nonzero(mask[:, None] >> np.arange(OWN) & 1)
            shard, window = shard[row], start[row] + k
            order = np.lexsort((window, shard))
            shard, window = shard[order], window[order]
            breaks = np.flatnonzero((np.diff(shard) != 0) | (np.diff(window) > 1))
            first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(window) - 1]])
            texts = [words[x:y + LENGTH].tobytes() for x, y in zip(window[first].tolist(), window[last].tolist())]
            n = len(first)
            yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.int64()), pa.array([b] * n, pa.int64()), pa.array(shard[first]), pa.array(window[first]), pa.array(texts, pa.binary())], names=["a", "b", "shard", "first", "words"])

    return _by_text(found, ["start", "shard", "mask"], docs, run, "a bigint, b bigint, shard bigint, first bigint, words binary")


def _matched(streams: DataFrame, sent) -> DataFrame:
    """(a, b, first, count): the runs of windows for which a shard's automaton has a match of their whole length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[int, SuffixAutomaton] = {}
        for batch in batches:
            shards = np.asarray(batch.column(2))
            rows, firsts, counts = [], [], []
            for shard in np.unique(shards):
                if shard not in loaded:
                    loaded[shard] = pickle.loads(sent.value[int(shard)])
                at = np.flatnonzero(shards == shard)
                for k, lengths in zip(at, loaded[shard].matches([np.frombuffer(batch.column(4)[k].as_py(), dtype=np.uint64) for k in at])):
                    change = np.diff((lengths[LENGTH - 1:] >= LENGTH).astype(np.int8), prepend=0, append=0)
                    starts = np.flatnonzero(change == 1)
                    rows += [k] * len(starts)
                    firsts.append(starts + batch.column(3)[k].as_py())
                    counts.append(np.flatnonzero(change == -1) - starts)
            if rows:
                marks = batch.select([0, 1]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*marks.columns, pa.array(np.concatenate(firsts)), pa.array(np.concatenate(counts))], names=["a", "b", "first", "count"])

    return streams.select("a", "b", "shard", "first", "words").mapInArrow(run, "a bigint, b bigint, first bigint, count bigint")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, first, count) of the runs of windows that occur elsewhere, as the automata find them."""
    spark, texts = docs.sparkSession, _rows(docs, id_col, text_col)
    every = stored(_places(texts), "places")
    again = every.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min("region").alias("one"), F.max("region").alias("two")).where("n > 1")
    again = stored(again.select("print", (F.col("one") == F.col("two")).alias("alone")), "prints")
    found = stored(every.join(small_or_shuffled(again), "print"), "found")
    removed(every, again)
    regions = stored(found.groupBy("print", "region", "alone").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b", "start", "windows")).alias("place")).select("print", "region", "alone", "n", "place.*"), "regions")

    # Which windows occur again, and the place of each that the reference takes.
    hashes = _window_hashes(regions.where("not alone"), texts)
    windows = hashes.select("print", "region", "n", "a", "b", F.posexplode("windows").alias("k", "window"), "start").withColumn("at", F.col("start") + F.col("k"))
    again = windows.groupBy("print", "window").agg(F.sum("n").alias("n"), F.min(F.struct("a", "b", "at")).alias("place")).where("n > 1")
    again = stored(again.select("print", "window", "place.*"), "windows-again")
    alone = regions.where("alone")
    reference = alone.select("a", "b", F.col("start").alias("first"), F.col("windows").cast("int").alias("count")).unionByName(again.select("a", "b", F.col("at").alias("first"), F.lit(1).alias("count")))
    spans = _spans(reference, texts)
    words = spans.agg(F.sum(F.octet_length("words").cast("bigint")).alias("n")).first()["n"] or 0
    shards = max(1, -(-words // (8 * SHARD_WORDS)))
    rounds = -(-shards // SHARDS)
    shard = F.pmod(F.xxhash64("a", "b", "piece"), F.lit(shards)).alias("shard")

    # Which windows of a region are in which shard: bit k for the region's k-th window.
    piece = F.expr(f"at div {PIECE}").cast("int").alias("piece")
    of_several = windows.select("print", "region", "window", "k").join(small_or_shuffled(again), ["print", "window"]).select("print", "region", "k", "a", "b", piece).select("print", "region", "k", shard)
    of_several = of_several.groupBy("print", "region", "shard").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("mask"))
    pieces = F.explode(F.expr(f"sequence(int(start div {PIECE}), int((start + windows - 1) div {PIECE}))")).alias("piece")
    low, high = f"greatest(0, piece * {PIECE} - start)", f"least(windows, (piece + 1) * {PIECE} - start)"
    of_alone = alone.select("print", "region", "a", "b", "start", "windows", pieces).select("print", "region", shard, F.expr(f"shiftleft(1, int({high})) - shiftleft(1, int({low}))").alias("mask"))
    targets = stored(of_several.unionByName(of_alone), "targets")
    removed(hashes, again, regions)

    paths = [shared_path(spark, name) for name in ("automata", "streams", "matched")]
    _automata(spans.select(shard, "words")).write.partitionBy("round").parquet(paths[0])
    removed(spans)
    streams = _streams(found.select("a", "b", "start", "print", "region").join(small_or_shuffled(targets), ["print", "region"]), texts)
    removed(found, targets)
    if rounds > 1:  # a round's in few files, and those of a passage that occurs everywhere in many tasks
        dealt = streams.repartitionByRange(task_count(streams), "shard", "a")
    else:
        dealt = streams
    dealt.withColumn("round", F.expr(f"shard div {SHARDS}")).write.partitionBy("round").parquet(paths[1])
    removed(streams)
    for k in range(rounds if words else 0):
        rows = spark.read.schema("shard bigint, automaton binary, round bigint").parquet(paths[0]).where(F.col("round") == k).collect()
        sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["automaton"]) for r in rows})
        del rows
        part = spark.read.schema("a bigint, b bigint, shard bigint, first bigint, words binary, round bigint").parquet(paths[1]).where(F.col("round") == k)
        _matched(part, sent).write.parquet(f"{paths[2]}/{k}")
        sent.destroy()
    delete(spark, *paths[:2])
    schema = "a bigint, b bigint, first bigint, count bigint"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(paths[2]) if words else spark.createDataFrame([], schema)


def covered(n: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The words of a text of n words that runs of windows cover."""
    edge = np.bincount(first, minlength=n + 1) - np.bincount(first + count + LENGTH - 1, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space); with texts, kept_text too.

    Words are runs of bytes other than ASCII white space, unchanged. Null texts have none; texts of fewer than 35 words
    keep all. Rows that repeat an identifier are texts of their own, and a repeated row makes all its windows repeated. A
    null identifier is an identifier like others, and identifiers may be of any type. A text of any length is one value of
    one task, with some 40 bytes a word. An empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    # A set: it has the places of one text at most, however often the row is repeated.
    windows = stored(repeated_windows(docs, id_col, text_col).groupBy("a", "b").agg(F.collect_set(F.struct("first", "count")).alias("rows")), "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                n_words, n_removed, digests, kept_texts = [], [], [], []
                for k in range(part.num_rows):
                    words, gone = (part.column(1)[k].as_py() or b"").split(), 0
                    n_words.append(len(words))
                    if part.column(2)[k].is_valid:
                        rows = pa.RecordBatch.from_struct_array(part.column(2)[k].values)
                        away = covered(len(words), *(np.asarray(c).astype(np.int64) for c in rows.columns))
                        gone = int(away.sum())
                        words = [w for w, x in zip(words, away.tolist()) if not x]
                    kept = b" ".join(words)
                    n_removed.append(gone)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if texts:
                        kept_texts.append(kept.decode("utf-8", "replace"))
                out = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(kept_texts, pa.string())] * texts, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts)

    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts
    rows = _rows(docs, id_col, text_col)
    keys = small_or_shuffled(windows.select("a", "b"))
    touched = rows.join(keys, ["a", "b"], "left_semi").join(windows, ["a", "b"])
    clean = rows.join(keys, ["a", "b"], "left_anti").withColumn("rows", F.lit(None).cast(dict(windows.dtypes)["rows"]))
    return touched.select("doc_id", "text", "rows").unionByName(clean.select("doc_id", "text", "rows")).mapInArrow(run, schema)


# A corpus against a list of texts.

def remove_known(docs: DataFrame, reference: list[str], length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_removed, kept_text, without the words under a match of `length` words with a reference text.

    The list is the driver's; its automata, some 70 bytes a word, are broadcast a shard at a time and loaded one after the
    other. Null and empty texts keep nothing, an empty list removes nothing; rows are independent of each other, so repeated
    rows and identifiers, null identifiers, other columns and empty tables change nothing.
    """
    shards: list[list[np.ndarray]] = [[]]
    size = 0
    for text in reference:
        words = hashed(text.encode().split())
        for k in range(0, len(words), SHARD_WORDS):  # pieces overlap by a match less one word
            if size >= SHARD_WORDS:
                shards.append([])
                size = 0
            shards[-1].append(words[k:k + SHARD_WORDS + length - 1])
            size += len(shards[-1][-1])
    ship(docs.sparkSession)
    sent = [docs.sparkSession.sparkContext.broadcast(pickle.dumps(SuffixAutomaton(s))) for s in shards]
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(v.as_py() or b"").split() for v in batch.column(1)]
            hashes = [hashed(words) for words in texts]
            pieces = [(t, k) for t, h in enumerate(hashes) for k in range(0, len(h), PIECE)]
            cut = [hashes[t][k:k + PIECE + length - 1] for t, k in pieces]
            edges = [np.zeros(len(h) + 1, dtype=np.int64) for h in hashes]
            for shard in sent:
                for (t, k), found in zip(pieces, pickle.loads(shard.value).matches(cut)):
                    end = k + np.flatnonzero(found >= length) + 1
                    edges[t] += np.bincount(end - length, minlength=len(edges[t])) - np.bincount(end, minlength=len(edges[t]))
            away = [np.cumsum(e)[:-1] > 0 for e in edges]
            kept = [b" ".join(w for w, x in zip(words, gone.tolist()) if not x).decode("utf-8", "replace") for words, gone in zip(texts, away)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(x.sum()) for x in away], pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_removed", "kept_text"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_removed bigint, kept_text string")
