import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from ordinate.llm import byte_bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "abestrvlmdXY'' \n\t\r　\xa0éß中1²٣!?.-_ <|endoftext|>\U0001F600́\x1c\x85​"
FIXED = [
    "", " ", "  ", "a", "it's you'll we'd I'm 'tis 's'", "'", "''re'", "x  \n\n y\n", "<|endoftext|>", "a  <|endoftext|>  b<|endoftext|><|endoftext", "don't'r'v'll'l",
    "a" * 3000, "=" * 2500, " " * 2000, "ab" * 1500 + " ", "The  quick\tbrown\u3000fox", "\u00a0\u00a0x", "naïve 中文 текст １２３ ٣٤ ²", "e\u0301" * 20, "\ud7ff\ue000",
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    return FIXED + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 80))) for _ in range(1500)] + ["".join(chr(r.choice((r.randint(32, 0x2FFF), r.randint(32, 126)))) for _ in range(40)) for _ in range(300)]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return Tokenizer.from_file(JSON)


def test_encoding_is_the_librarys(texts, library):
    bpe = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    for t in texts:
        ids = bpe.encode(t)
        assert ids == library.encode_ordinary(t), t
        assert bpe.decode(ids) == t.encode()


def test_long_texts_come_in_blocks(monkeypatch, texts, library):
    monkeypatch.setattr(byte_bpe, "BLOCK", 7)
    monkeypatch.setattr(byte_bpe, "MEMO", 5)
    bpe = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    for t in texts[:200]:
        assert bpe.encode(t) == library.encode_ordinary(t)


def test_perfect_hash():
    keys = [str(k).encode() for k in range(1000)]
    found = byte_bpe.PerfectHash(keys)
    assert sorted(map(found.find, keys)) == list(range(1000))
    assert all(found.find(str(k).encode()) == -1 for k in range(1000, 3000))
    assert byte_bpe.PerfectHash([]).find(b"x") == -1


def test_encode_and_decode_tables(spark, texts, library):
    rows = [(k, t, 1) for k, t in enumerate(texts[:300])] + [(1, None, 2), (None, "x y", 3), (5, texts[5], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    ids = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), r.ids) for r in ids.collect()) == sorted((str(i), library.encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in byte_bpe.decode(ids, RANKS).collect()) == sorted((str(i), (t or "").encode()) for i, t, _ in rows)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(e := library.encode_ordinary(t or "")), sha(" ".join(map(str, e)).encode()), sha((t or "").encode())) for i, t, _ in rows)
    got = byte_bpe.encode_digests(df, RANKS, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert byte_bpe.encode_digests(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def machine():
    with open(JSON, encoding="utf-8") as f:
        return token_counts.Transducer(f.read())


def test_counts_are_the_librarys(texts, machine, counter):
    for t in texts:
        assert machine.count(t) == len(counter.encode(t, add_special_tokens=False).ids), t


def test_chunks_compose_anywhere(texts, machine, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 3)
    for t in texts[:400]:
        assert machine.count(t) == len(counter.encode(t, add_special_tokens=False).ids), t


def test_states_are_bounded(texts, counter, monkeypatch, machine):
    monkeypatch.setattr(token_counts, "STATES", 50)
    monkeypatch.setattr(token_counts, "PAIRS", 20)
    monkeypatch.setattr(token_counts, "WORDS", 10)
    machine.restart()
    machine.follows.clear()
    for t in texts[30:400]:
        assert machine.count(t) == len(counter.encode(t, add_special_tokens=False).ids), t


def test_states_are_bounded_within_a_text(counter, monkeypatch, machine):
    monkeypatch.setattr(token_counts, "STATES", 3000)
    monkeypatch.setattr(token_counts, "STRETCH", 64)
    machine.restart()
    r = random.Random(6)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    most = 0
    restart = type(machine).restart

    def watched(self):
        nonlocal most
        most = max(most, len(self.states))
        restart(self)

    monkeypatch.setattr(type(machine), "restart", watched)
    assert machine.count(text) == len(counter.encode(text, add_special_tokens=False).ids)
    assert 3000 < most <= 3000 + 64 + 1 and len(machine.states) <= 3065


def test_composition_is_associative(machine):
    text = "it's a  long\n\ntext' of ,words' and\u3000'll spaces " * 3
    maps = [machine.chunk(text[k:k + 5]) for k in range(0, len(text), 5)]
    left = maps[0]
    for m in maps[1:]:
        left = machine.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = machine.compose(m, right)
    scanned = machine.scan(maps)
    results = {(m.exit, machine.run(token_counts.START, m.head)[1] + m.count) for m in (left, right, scanned[-1])}
    assert len(results) == 1 and len(scanned) == len(maps)


def test_pairs_stay_apart_as_merging_says(machine):
    r = random.Random(9)
    ids = list(machine.bytes_of)
    for a, b in [(r.choice(ids), r.choice(ids)) for _ in range(4000)] + [(i, i) for i in r.sample(ids, 2000)]:
        assert machine.stay_apart(a, b) == (machine.merged(machine.bytes_of[a] + machine.bytes_of[b]) == [a, b])


def test_count_table(spark, texts, counter):
    rows = [(k, t, 1) for k, t in enumerate(texts[:200])] + [(1, None, 2), (None, "x y", 3), (5, texts[5], 1), (9, "w x " * 60_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").repartition(3)
    got = token_counts.token_counts(df, JSON, limit=20)
    count = lambda t: len(counter.encode(t or "", add_special_tokens=False).ids)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == sorted((str(i), len((t or "").encode()), count(t), count(t) > 20) for i, t, _ in rows)
    assert token_counts.token_counts(df.limit(0), JSON).count() == 0
