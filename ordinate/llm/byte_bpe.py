"""Byte-level BPE encoding and decoding by a two-tier lookup.

Each match of the splitting pattern is first looked up whole, in a minimal perfect hash of the vocabulary. Only matches
that are no token are merged: a heap orders the adjacent pairs of a linked list of byte spans by rank, then by place.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinate.llm.shared import ship

#: Matches whose ids a worker remembers; then it forgets all and starts again.
MEMO = 500_000

#: Matches that are taken from a text at a time.
BLOCK = 200_000

MIX = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """A minimal perfect hash of byte strings: hash and displace.

    Keys fall into buckets; from the largest bucket down, each takes the first displacement that sends its keys to free
    slots. A bucket of one key stores its slot itself, as a negative number. Keys are kept, so that others are told apart.
    """

    def __init__(self, keys: Iterable[bytes]):
        keys = list(dict.fromkeys(keys))
        self.n = max(1, len(keys))
        self.buckets = self.n // 3 + 1
        self.shift = array("q", bytes(8 * self.buckets))
        self.keys: list[bytes | None] = [None] * self.n
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        order = sorted(groups.items(), key=lambda g: -len(g[1]))
        free: list[int] | None = None
        for bucket, group in order:
            if len(group) == 1:
                free = free if free is not None else [s for s in range(self.n) if self.keys[s] is None]
                slot = free.pop()
                self.shift[bucket], self.keys[slot] = -slot - 1, group[0][1]
                continue
            d = 0
            while True:
                slots = [self._slot(h, d) for h, _ in group]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.shift[bucket] = d
            for slot, (_, key) in zip(slots, group):
                self.keys[slot] = key

    def _slot(self, h: int, d: int) -> int:
        return ((((h ^ (d * MIX)) * MIX) & MASK) >> 20) % self.n

    def find(self, key: bytes) -> int:
        """The key's slot, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return slot if self.keys[slot] == key else -1


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.ranks = ranks
        self.hash = PerfectHash(ranks)
        self.rank_at = array("q", (ranks[k] if k is not None else -1 for k in self.hash.keys))
        self.token = {rank: token for token, rank in ranks.items()}
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern)
        self.memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def rank(self, piece: bytes) -> int:
        slot = self.hash.find(piece)
        return -1 if slot < 0 else self.rank_at[slot]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a piece that is no token itself."""
        n, rank = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # of the span that starts at each byte; 0 once it is part of another
        before = list(range(-1, n - 1))
        heap = [(r, k, k + 1, k + 2) for k in range(n - 1) if (r := rank(piece[k:k + 2])) is not None]
        heapify(heap)
        while heap:
            _, left, middle, right = heappop(heap)
            if end[left] != middle or end[middle] != right:
                continue
            end[left], end[middle] = right, 0
            if right < n:
                before[right] = left
                if (r := rank(piece[left:end[right]])) is not None:
                    heappush(heap, (r, left, right, end[right]))
            if (prior := before[left]) >= 0 and (r := rank(piece[prior:right])) is not None:
                heappush(heap, (r, prior, left, right))
        ids, at = [], 0
        while at < n:
            ids.append(rank(piece[at:end[at]]))
            at = end[at]
        return tuple(ids)

    def _piece(self, match: str) -> tuple[int, ...]:
        piece = match.encode("utf-8", "replace")
        r = self.rank(piece)
        ids = (r,) if r >= 0 else self.merge(piece)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(match) <= 64:
            self.memo[match] = ids
        return ids

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, a list for each so many matches, so that a long text needs no more memory."""
        memo, piece = self.memo, self._piece
        for part in self._matches(text):
            ids: list[int] = []
            for match in part:
                ids += memo.get(match) or piece(match)
            yield ids

    def _matches(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BLOCK:
            yield self.split.findall(text)
            return
        found = (m.group() for m in self.split.finditer(text))
        while part := list(islice(found, BLOCK)):
            yield part

    def encode(self, text: str) -> list[int]:
        return [i for block in self.blocks(text) for i in block]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])


def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(load_ranks(path), pattern)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int). Null texts count as empty; bytes that are no UTF-8 as U+FFFD; repeated rows, null
    identifiers, other columns and empty tables change nothing. The ids of a long text are one value of one task."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [shared.value.encode((v.as_py() or b"").decode("utf-8", "replace")) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = _texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, bytes (the decoded ids; null ids decode to no bytes)."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b"".join([shared.value[i] for i in v.as_py() or ()]) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, bytes binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the ids decoded).

    Null texts count as empty: no tokens, digests of no bytes. Rows are independent of each other, so repeated rows and
    identifiers, null identifiers, other columns and empty tables change nothing; a text is taken in blocks of matches.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        token, name = bpe.token, {i: str(i) for i in bpe.token}
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for value in batch.column(1):
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for ids in bpe.blocks((value.as_py() or b"").decode("utf-8", "replace")):
                    if ids:
                        of_ids.update((" " * (n > 0) + " ".join([name[i] for i in ids])).encode())
                        of_bytes.update(b"".join([token[i] for i in ids]))
                        n += len(ids)
                counts.append(n)
                ids_sha.append(of_ids.hexdigest())
                decoded_sha.append(of_bytes.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = _texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
