"""Toxicity by gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities and counts of a lexicon of words and word beginnings that mark toxic texts, their nearness to words of the second
person, capitals, punctuation, and the rate of obfuscated words and of lexicon words found once they are undone. Lexicon,
trees and calibration are learned from a bounded sample of labelled rows; scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinate.llm.shared import ship

#: Labelled identifiers of each class, bytes of a text, and bytes of all texts that training takes at most. They are taken by a
#: hash of the identifier.
SAMPLE_PER_CLASS = 4000
SAMPLE_BYTES = 1 << 16
SAMPLE_TOTAL = 96 << 20

THRESHOLD = 0.3
LEXICON = 400
LEAST_TEXTS, LEAST_ODDS = 3, 0.5
STEMS = (4, 5, 6)
FOLDS = 4
#: Odd factors, each of which orders hashes anew.
MULTIPLIERS = (1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
NEAR = 5

# Words of the second person in four languages, and signs that stand for letters.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros os su sus".split())
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", "_": "", "-": "", ".": ""})

TOKEN = re.compile(r"[^\s]+")
EDGE = ".,;:!?\"'()[]{}<>«»„“”…*#%&$-_~"
TWICE = re.compile(r"(.)\1{2,}")
PUNCTUATION = re.compile(r"[!?]")
NAMES = ("hits", "weight", "strongest", "near_you", "hidden", "obfuscated", "capitals", "shouted", "marks", "long_marks", "you", "log_words", "log_hits", "log_different")


def undone(word: str) -> str:
    return TWICE.sub(r"\1", word.translate(SIGNS))


def tokens(text: str) -> list[str]:
    return [w for t in TOKEN.findall(text.lower()) if (w := t.strip(EDGE))]


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]
    cache: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        w = self.words.get(word)
        if w is None:
            w = max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n), default=0.0)
        return w

    @staticmethod
    def learn(seen: tuple[Counter, Counter], n: tuple[int, int]) -> Lexicon:
        """Words and beginnings that far more toxic than clean texts have: the log of the odds, less two standard errors, is
        over LEAST_ODDS. seen: texts of each class by token; n: texts of each class."""
        found = []
        for token, c in seen[1].items():
            if c < LEAST_TEXTS:
                continue
            d = seen[0][token]
            odds = log((c + 0.5) / (n[1] + 1)) - log((d + 0.5) / (n[0] + 1))
            sure = odds - 2 * (1 / (c + 0.5) + 1 / (d + 0.5)) ** 0.5
            if sure > LEAST_ODDS:
                found.append((sure, token))
        best = sorted(found, reverse=True)[:LEXICON]
        return Lexicon({t[1]: o for o, t in best if t[0] == "word"}, {t[1]: o for o, t in best if t[0] == "stem"})


def lexicon_tokens(text: str) -> set[tuple[str, str]]:
    words = set(tokens(text))
    return {("word", w) for w in words if len(w) > 2} | {("stem", w[:k]) for w in words for k in STEMS if len(w) > k}


def apart(texts: list[str]) -> list[int]:
    """Places of texts without those that repeat most of an earlier one: else the words of one text that was copied often
    would look like words of its class. Texts are alike if the smallest hashes of their runs of three words meet."""
    kept, seen = [], set()
    for k, text in enumerate(texts):
        words = tokens(text)
        runs = np.array([crc32(" ".join(words[j:j + 3]).encode()) for j in range(max(1, len(words) - 2))], dtype=np.uint64)
        keys = {(j, int(((runs * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for j, m in enumerate(MULTIPLIERS)}
        if not keys & seen:
            kept.append(k)
        seen |= keys
    return kept


def features(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    """One row of NAMES; a text without words has zeros."""
    raw = TOKEN.findall(text)
    hits, different, hidden, odd, you, shouted, n = [], set(), 0, 0, [], 0, 0
    weight, cache = lexicon.weight, lexicon.cache
    total = strongest = 0.0
    for token in raw:
        word = token.strip(EDGE)
        if not word:
            continue
        lower = word.lower()
        w = cache.get(lower)
        if w is None:
            if len(cache) > 100_000:
                cache.clear()
            w = cache[lower] = weight(lower)
        if w:
            hits.append(n)
            different.add(lower)
            total += w
            strongest = max(strongest, w)
        elif lower in YOU:
            you.append(n)
        if not word.isalpha() and any(c.isalpha() for c in word) and "'" not in word and "’" not in word:
            odd += 1
            hidden += weight(undone(lower)) > 0
        if len(word) > 2 and word.isupper():
            shouted += 1
        n += 1
    if not n:
        return (0.0,) * len(NAMES)
    near = 0
    if hits and you:
        at = np.asarray(you)
        place = np.searchsorted(at, hits)
        gaps = np.minimum(np.abs(at[np.minimum(place, len(at) - 1)] - hits), np.abs(at[np.maximum(place - 1, 0)] - hits))
        near = int((gaps <= NEAR).sum())
    letters = max(1, len(text))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = text.count("!") + text.count("?")
    return (len(hits) / n, total / n, strongest, near / n, hidden / n, odd / n, upper / letters, shouted / n, marks / letters, (text.count("!!") + text.count("??")) / letters, len(you) / n, log(n), log(1 + len(hits)), log(1 + len(different)))


class Boosted:
    """Regression trees on the logistic loss, over binned features."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, smooth: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.smooth = trees, depth, rate, bins, smooth
        self.fitted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        mean = np.clip(np.average(y, weights=w), 1e-6, 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (p - y), w * p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            which = np.zeros(2 ** self.depth - 1, dtype=np.int64)
            cut = np.full(2 ** self.depth - 1, np.inf)
            for level in range(self.depth):
                for k in range(2 ** level - 1, 2 ** (level + 1) - 1):
                    here = node == k
                    best = (1e-9, 0, np.inf)
                    if here.any():
                        gs, hs = g[here].sum(), h[here].sum()
                        for f, c in enumerate(cuts):
                            if not len(c):
                                continue
                            gl = np.cumsum(np.bincount(codes[here, f], g[here], len(c) + 1))[:-1]
                            hl = np.cumsum(np.bincount(codes[here, f], h[here], len(c) + 1))[:-1]
                            gain = gl ** 2 / (hl + self.smooth) + (gs - gl) ** 2 / (hs - hl + self.smooth) - gs ** 2 / (hs + self.smooth)
                            at = int(gain.argmax())
                            if gain[at] > best[0]:
                                best = (gain[at], f, c[at])
                    which[k], cut[k] = best[1], best[2]
                node = 2 * node + 1 + (x[np.arange(len(y)), which[node]] > cut[node])
            leaf = node - (2 ** self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2 ** self.depth) / (np.bincount(leaf, h, 2 ** self.depth) + self.smooth)
            score += value[leaf]
            self.fitted.append((which, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for which, cut, value in self.fitted:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, which[node]] > cut[node])
            out += value[node - (2 ** self.depth - 1)]
        return out


class Isotonic:
    """The nearest non-decreasing step function, by pooling adjacent violators; straight lines between steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # weight, weighted sum, first x, last x
        for a, b, c in zip(x[order], y[order], w[order]):
            pools.append([c, b * c, a, a])
            while len(pools) > 1 and (pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0] or pools[-2][3] == pools[-1][2]):
                c, s, _, last = pools.pop()
                pools[-1][0] += c
                pools[-1][1] += s
                pools[-1][3] = last
        self.x = np.array([v for p in pools for v in (p[2], p[3])])
        self.y = np.array([p[1] / p[0] for p in pools for _ in range(2)])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    calibration: Isotonic

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features(t, self.lexicon) for t in texts])
        return np.clip(self.calibration.predict(self.trees.score(x)), 0.0, 1.0)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights: at most SAMPLE_PER_CLASS identifiers of each class, never held out, each weighing as many
    labelled rows as it stands for. Sizes come first, so that no more than SAMPLE_TOTAL bytes are ever collected; an identifier
    whose texts do not fit is passed over."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.md5(F.col("id").cast("string"))
    taken = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "id").limit(SAMPLE_PER_CLASS)
        taken = part if taken is None else taken.unionByName(part)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(taken), "id")
    total, chosen = 0, []
    for r in texts.groupBy("id").agg(F.sum(F.octet_length("text") + 64).alias("size")).orderBy(order, "id").collect():
        if total + r["size"] <= SAMPLE_TOTAL:
            total += r["size"]
            chosen.append((r["id"],))
    wanted = docs.sparkSession.createDataFrame(chosen, f"id {dict(texts.dtypes)['id']}")
    rows = texts.join(F.broadcast(wanted), "id").select("id", "text", "y").orderBy(order, F.md5("text")).collect()
    y = np.array([r["y"] for r in rows], dtype=float)
    weight = np.array([counts[r["y"]] / max(1, int((y == r["y"]).sum())) for r in rows])
    return [r["text"] for r in rows], y, weight


def train(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Model:
    """Features come from a lexicon that the text's fold had no part in, and calibration from trees that it had no part in,
    so that neither trusts words that are only chance. Without rows of both classes every text gets the rate of the labels."""
    kept = apart(texts)
    texts, y, weight = [texts[k] for k in kept], y[kept], weight[kept]
    if len(set(y)) < 2:
        rate = np.array([float(y.mean()) if len(y) else 0.0])
        flat = Boosted(trees=0).fit(np.zeros((1, len(NAMES))), rate, np.ones(1))
        return Model(Lexicon({}, {}), flat, Isotonic().fit(np.zeros(1), rate, np.ones(1)))
    fold = np.zeros(len(y), dtype=int)
    for label in (0, 1):
        here = np.flatnonzero(y == label)
        fold[here] = np.arange(len(here)) % FOLDS
    seen = {(f, label): Counter() for f in range(FOLDS) for label in (0, 1)}
    for text, f, label in zip(texts, fold, y):
        seen[f, int(label)].update(lexicon_tokens(text))

    def lexicon(without: int | None) -> Lexicon:
        counts, n = [], []
        for label in (0, 1):
            total = Counter()
            for f in range(FOLDS):
                if f != without:
                    total.update(seen[f, label])
            counts.append(total)
            n.append(int(((y == label) & (fold != without)).sum()))
        return Lexicon.learn(tuple(counts), tuple(n))

    held = [lexicon(f) for f in range(FOLDS)]
    x = np.array([features(t, held[f]) for t, f in zip(texts, fold)])
    weight = weight / weight.mean()
    out = np.zeros(len(y))
    for f in range(FOLDS):
        rest = fold != f
        out[~rest] = Boosted().fit(x[rest], y[rest], weight[rest]).score(x[~rest])
    return Model(lexicon(None), Boosted().fit(x, y, weight), Isotonic().fit(out, y, weight))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    model = train(*sample(docs, labels, id_col, text_col))
    model.lexicon.cache.clear()
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Null and empty texts have no words and get the score that zeros give. A null identifier is not held out. Rows are
    scored one by one, so repeated rows, other columns and empty tables change nothing. Long texts are scored whole, though
    the model is fitted on texts of at most SAMPLE_BYTES.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                scores = shared.value.scores([(v.as_py() or b"").decode("utf-8", "replace") for v in part.column(2)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is not predicted toxic; null and empty texts as in toxicity(), repeats each on its own."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(shared.value.scores([t or "" for t in texts]))

    return docs.where(score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) < THRESHOLD)
