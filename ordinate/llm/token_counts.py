"""Token counts by a deterministic transducer compiled from a byte-level BPE tokenizer.

A state is what is left of a text that future tokens depend on: the kind of the piece (word, number, other, white space,
contraction) under way, and for each place in it where a token could still start that reaches further, the vocabulary
prefix read from there, the last token before it, and its count relative to here. Merges are local: a token may follow
another if the two side by side are encoded as themselves, and of the tokens that end at a place exactly one follows the
one before it. A transition is annotated with the tokens it adds, which may be none or fewer. States are compiled as
texts reach them; beyond a bound all are dropped and compiled anew, so memory is bounded and results are not affected.

A text is cut into chunks anywhere. A chunk's state map is the same for every entry state from the first white space
after a non-space on: what stands before that place (its head), and from there the exit state and count. Maps compose
associatively, so a tree of compositions gives the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinate.llm.shared import ship

#: States and transitions a worker keeps.
STATES = 300_000
TRANSITIONS = 1_500_000

#: Characters between looks at the bounds.
STRETCH = 4096

#: Pairs of tokens whose order a worker remembers.
PAIRS = 500_000

#: Words whose map from the state after a space a worker remembers.
WORDS = 500_000

CHUNK = 1 << 16
GAP = regex.compile(r"(?<=\S) (?=\S)")
SYNC = regex.compile(r"(?<=\S)\s")
SPACE, LETTER, NUMBER = (regex.compile(p) for p in (r"\s", r"\p{L}", r"\p{N}"))
SHORT, LONG = {"s", "t", "m", "d"}, {"r": "e", "v": "e", "l": "l"}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 for itself, the rest from U+0100 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class StateMap:
    head: str
    exit: tuple | None  # None: the chunk is all head
    count: int


class State(dict):
    """Character -> (state, tokens added); filled as characters come."""

    __slots__ = ("key", "machine")

    def __init__(self, key: tuple, machine: Transducer):
        self.key, self.machine = key, machine

    def __missing__(self, char: str) -> tuple[State, int]:
        key, added = self.machine.step(self.key, char)
        self.machine.transitions += 1
        out = self[char] = self.machine.state(key), added
        return out


class Transducer:
    def __init__(self, tokenizer: str):
        """tokenizer: JSON of a byte-level BPE tokenizer."""
        read = json.loads(tokenizer)
        model, letters = read["model"], byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in read.get("added_tokens", ())]
        vocab = {raw(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[raw(a)], vocab[raw(b)]): (k, vocab[raw(a + b)]) for k, (a, b) in enumerate(pairs)}
        self.bytes_of = {i: t for t, i in vocab.items()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.made = {new: (k, a, b) for (a, b), (k, new) in sorted(self.merges.items(), key=lambda m: -m[1][0])}
        self._ready()

    def _ready(self) -> None:
        self.follows: dict[tuple[int, int], bool] = {}
        self.kinds: dict[str, str] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, text in self.bytes_of.items():
            if len(text) > 1 and self.merged(text) != [token]:
                continue  # no text gives it
            node = 0
            for b in text:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                node = self.trie[node][b]
            self.ends[node] = token
        self.restart()

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("special", "merges", "bytes_of", "single", "made")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def restart(self) -> None:
        self.states: dict[tuple, State] = {}
        self.transitions = 0
        self.words: dict[str, int] = {}

    def state(self, key: tuple) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(key, self)
        return found

    # Tokens within a piece.

    def merged(self, text: bytes) -> list[int]:
        """The text's tokens by the merge rules: the reference that transitions are compiled from."""
        return self.merge_ids([self.single[b] for b in text])

    def merge_ids(self, ids: list[int]) -> list[int]:
        while len(ids) > 1:
            found = [(m[0], k, m[1]) for k, pair in enumerate(zip(ids, ids[1:])) if (m := self.merges.get(pair))]
            if not found:
                break
            _, at, new = min(found)
            ids = [*ids[:at], new, *ids[at + 2:]]
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) >= PAIRS:
                self.follows.clear()
            known = self.follows[a, b] = self.stay_apart(a, b)
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether a text of token a and token b has just these two tokens: going back through the merges that made them,
        latest first, no pair of neighbours across the border would have been merged before it was gone."""
        until = len(self.merges)
        while True:
            merge = self.merges.get((a, b))
            if merge is not None and merge[0] < until:
                return False
            of_a, of_b = self.made.get(a), self.made.get(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or of_a is not None and of_a[0] > of_b[0]:
                until, _, a = of_a
            else:
                until, b = of_b[0] + 1, of_b[1]  # of equal pairs the left one, which is the one across, goes first

    def feed(self, places: tuple, text: bytes) -> tuple[tuple, int]:
        """places: (trie node, last token before, count relative to here) for each place where a token may yet begin."""
        total = 0
        for b in text:
            last, here, on = -1, 0, []
            for node, before, count in places:
                child = self.trie[node].get(b)
                if child is None:
                    continue
                token = self.ends[child]
                if last < 0 and token >= 0 and (before < 0 or self.may_follow(before, token)):
                    last, here = token, count + 1
                if self.trie[child]:
                    on.append((child, before, count))
            total += here
            places = (*((node, before, count - here) for node, before, count in on), (0, last, 0))
        return places, total

    # Pieces within a text.

    def kind(self, char: str) -> str:
        found = self.kinds.get(char)
        if found is None:
            found = "W" if SPACE.match(char) else "L" if LETTER.match(char) else "N" if NUMBER.match(char) else "O"
            if len(self.kinds) < 100_000:
                self.kinds[char] = found
        return found

    def begin(self, char: str) -> tuple[tuple, int]:
        """A piece that starts with char."""
        kind = self.kind(char)
        if kind == "W":
            return ("W", EMPTY, char), 0
        if char == "'":
            return ("A", None, ""), 0
        places, n = self.feed(EMPTY, char.encode("utf-8", "replace"))
        return (kind, places, ""), n

    def step(self, key: tuple, char: str) -> tuple[tuple, int]:
        kind, places, held = key
        if kind == "S":
            return self.begin(char)
        if kind == "A":  # an apostrophe, perhaps with the first letter of a contraction of two
            if not held and char in SHORT or held and LONG[held] == char:
                return START, len(self.merged(("'" + held + char).encode()))
            if not held and char in LONG:
                return ("A", None, char), 0
            key, n = ("O", *self.apostrophe), 1
            if held:
                key, more = self.begin(held)
                n += more
            else:
                key = ("O", self.apostrophe[0], "")
            out, more = self.step(key, char)
            return out, n + more
        if kind == "W":
            if self.kind(char) == "W":
                places, n = self.feed(places, held.encode())
                return ("W", places, char), n
            if held == " ":
                places, n = self.feed(EMPTY, b" ")
                places, more = self.feed(places, char.encode("utf-8", "replace"))
                return (self.kind(char), places, ""), n + more
            _, n = self.feed(EMPTY, held.encode())
            out, more = self.begin(char)
            return out, n + more
        if self.kind(char) == kind:
            places, n = self.feed(places, char.encode("utf-8", "replace"))
            return (kind, places, ""), n
        return self.begin(char)

    @property
    def apostrophe(self) -> tuple[tuple, str]:
        return self.feed(EMPTY, b"'")[0], ""

    def final(self, key: tuple) -> int:
        """Tokens that the end of the text adds."""
        kind, places, held = key
        if kind == "W":
            return self.feed(places, held.encode())[1]
        return 1 + len(held) if kind == "A" else 0

    # Chunks.

    def run(self, key: tuple, text: str) -> tuple[tuple, int]:
        """Exit state and count. Every entry state is the same after a space between two words, so words are maps too."""
        first, *words = GAP.split(text)
        key, total = self.chars(key, first)
        if not words:
            return key, total
        total += self.final(key)
        last, maps = words.pop(), self.words
        for word in words:
            total += maps.get(word) or self.word(word)
        key, n = self.chars(AFTER_SPACE, last)
        return key, total + n

    def word(self, word: str) -> int:
        key, n = self.chars(AFTER_SPACE, word)
        n += self.final(key)
        if len(self.words) >= WORDS:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = n
        return n

    def chars(self, key: tuple, text: str) -> tuple[tuple, int]:
        """Character by character; a character makes one state and one transition at most, and a stretch of them is the most
        that the bounds are exceeded by."""
        total = 0
        for k in range(0, len(text), STRETCH):
            if len(self.states) > STATES or self.transitions > TRANSITIONS:
                self.restart()
            state = self.state(key)
            for char in text[k:k + STRETCH]:
                state, n = state[char]
                total += n
            key = state.key
        return key, total

    def chunk(self, text: str) -> StateMap:
        at = SYNC.search(text)
        if at is None:
            return StateMap(text, None, 0)
        exit, count = self.run(("W", EMPTY, at.group()), text[at.end():])
        return StateMap(text[:at.end()], exit, count)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if a.exit is None:
            # A white space between two chunks without one is found when the whole head is run.
            return StateMap(a.head + b.head, b.exit, b.count)
        middle, n = self.run(a.exit, b.head)
        return StateMap(a.head, middle, a.count + n) if b.exit is None else StateMap(a.head, b.exit, a.count + n + b.count)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """Inclusive prefix scan: neighbours are composed, the half as many are scanned, the others filled in."""
        if len(maps) < 2:
            return maps
        pairs = [self.compose(maps[k], maps[k + 1]) for k in range(0, len(maps) - 1, 2)]
        odd = self.scan(pairs)
        return [maps[0] if k == 0 else odd[k // 2] if k % 2 else self.compose(odd[k // 2 - 1], maps[k]) for k in range(len(maps))]

    def total(self, piece: str) -> int:
        """Tokens of a text without special strings."""
        if not piece:
            return 0
        if len(piece) <= CHUNK:
            key, n = self.run(START, piece)
        else:
            whole = self.scan([self.chunk(piece[k:k + CHUNK]) for k in range(0, len(piece), CHUNK)])[-1]
            key, n = self.run(START, whole.head)
            if whole.exit is not None:
                key, n = whole.exit, n + whole.count
        return n + self.final(key)

    def count(self, text: str) -> int:
        pieces = [text]
        for special in self.special:
            pieces = [p for piece in pieces for p in piece.split(special)] if special in text else pieces
        return len(pieces) - 1 + sum(map(self.total, pieces))


START = ("S", None, "")
EMPTY = ((0, -1, 0),)
AFTER_SPACE = ("W", EMPTY, " ")


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty; special strings in a text count as one token each, as the tokenizer's default has it. Rows
    are independent of each other, so repeated rows, null identifiers, other columns and empty tables change nothing. A text
    of any length is one value of one task, taken in chunks; what the transducer keeps is bounded within a text too.
    """
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(Transducer(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            counts = [machine.count((v.as_py() or b"").decode("utf-8", "replace")) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean")
