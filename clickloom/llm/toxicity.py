"""Toxicity scores from weak supervision: many voters, a generative label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, small_batches

#: Labelled rows that everything is fitted on, at most: those of the smallest hash of their id.
FIT_ROWS = 6_000
VOTERS, SURE = 40, 3.0  # learned lexicon voters, at most, and the least log odds of one (two standard errors below the estimate)
STEMS = (3, 4, 5, 7)  # letters of a longer word that count as a feature of their own
MIN_DOCS = 5  # documents of the fitting rows that a word must occur in

WORD = re.compile(r"[^\W\d_]+")
# A small general lexicon of insults, and patterns of hostile writing.
LEXICON = ["idiot", "moron", "stupid", "loser", "trash", "scum", "worthless", "pathetic", "disgusting", "clown", "dumb", "jerk", "ugly", "hate", "kill", "shut", "fool", "filth", "garbage", "vermin"]
PATTERNS = [
    r"\b(you|u) (are|r)\b.{0,20}\b(idiot|moron|stupid|trash|loser|scum|clown|pathetic|worthless|disgusting)",
    r"[!?]{3,}",
    r"\b[A-Z]{4,}( [A-Z]{4,}){2,}",
    r"\b(go|just) (die|away|to hell)\b",
    r"(?<=\w)[*#@$%]{2,}\w",
]


def stems_of(word: str) -> list[str]:
    """A word and, marked, its first letters, as an insult may come in many inflections."""
    return [word, *(f"^{word[:k]}" for k in STEMS if len(word) > k)]


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def words_of(text: str | None) -> set[str]:
    """Distinct words of a text and their stems."""
    return {x for w in distinct_words(text) for x in stems_of(w)}


def pattern_votes(text: str | None) -> list[bool]:
    return [bool(p.search(text)) if text else False for p in _compiled()]


_cache: list[re.Pattern] = []


def _compiled() -> list[re.Pattern]:
    if not _cache:
        _cache.extend(re.compile(p) for p in PATTERNS)
    return _cache


@dataclass
class LabelModel:
    """Two classes, binary voters; a vote's evidence is discounted by its correlation with others inside a class.

    A voter that ``abstains`` votes for toxic or not at all: that an insult is missing says nothing.
    """

    prior: float
    rates: np.ndarray  # voters x 2: chance of a vote in clean and toxic texts (the voters' accuracies)
    correlation: np.ndarray  # voters x voters, within classes
    abstains: np.ndarray  # by voter

    def posterior(self, votes: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
        prior = self.prior if prior is None else prior
        on = np.log(self.rates[:, 1]) - np.log(self.rates[:, 0])
        off = np.where(self.abstains, 0.0, np.log1p(-self.rates[:, 1]) - np.log1p(-self.rates[:, 0]))
        share = 1.0 / np.sqrt(np.maximum(self.correlation, 0).sum(axis=1))  # design effect of correlated votes
        logit = np.log(prior / (1 - prior)) + votes @ (share * (on - off)) + (share * off).sum()
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, abstains: np.ndarray | None = None, rounds: int = 25) -> LabelModel:
    """Expectation-maximisation; votes are a 0/1 matrix (rows x voters), ``start`` each row's chance before any vote."""
    q, model = start, None
    abstains = np.zeros(votes.shape[1], bool) if abstains is None else abstains
    for _ in range(rounds):
        weight = np.stack([1 - q, q])
        rates = ((weight @ votes + 0.05) / (weight.sum(axis=1, keepdims=True) + 1.0)).T
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        cov = np.zeros((votes.shape[1],) * 2)
        for y in (0, 1):
            d = votes - rates[:, y]
            cov += (d * weight[y][:, None]).T @ d
        cov /= max(len(votes), 1)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        corr = cov / scale / scale[:, None]
        corr[np.abs(corr) < 0.2] = 0.0  # noise
        np.fill_diagonal(corr, 1.0)
        model = LabelModel(float(np.clip(q.mean(), 0.005, 0.995)), rates, corr, abstains)
        q = model.posterior(votes, start)
    return model


def fit_linear(rows: np.ndarray, cols: np.ndarray, n: int, d: int, y: np.ndarray, steps: int = 800, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over sparse 0/1 features (row, column), by Adam on the whole batch."""
    w, b = np.zeros(d), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gw, gb = np.bincount(cols, g[rows], d) + decay * w, float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


class Telling(dict):
    """The features with a weight among a word and its stems, found by their hashes when the word is first met."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = tuple(h for h in map(word_hash, stems_of(word)) if h in self.weights)
        return found


@dataclass
class Classifier:
    weights: dict[int, float]  # by word hash
    patterns: np.ndarray
    bias: float

    def score(self, text: str | None, telling: Telling | None = None) -> float:
        z = self.bias
        if text:
            telling = Telling(self.weights) if telling is None else telling
            found = set().union(*map(telling.__getitem__, distinct_words(text)))
            z += math.fsum([self.weights[h] for h in found]) + float(self.patterns @ np.array(pattern_votes(text), float))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit voters, label model and classifier on at most FIT_ROWS labelled rows (the caller leaves out held-out ones).

    Near copies of a text would make its rare words look telling, so of rows whose word
    sets have the same 16 smallest hashes only one counts.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # FIT_ROWS ids at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.sort(np.fromiter(map(word_hash, w := words_of(t.as_py())), np.int64, len(w))) for t in b["text"]]
            votes = [sum(v << i for i, v in enumerate(pattern_votes(t.as_py()))) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array(sets, pa.list_(pa.int64())), pa.array(votes, pa.int32())], ["doc_id", "toxic", "words", "patterns"])

    # hashes of words, not words: some tens of MB for the rows of FIT_ROWS texts
    found = joined.select("doc_id", "text", "toxic").mapInArrow(extract, "doc_id long, toxic int, words array<long>, patterns int").toArrow().combine_chunks()
    if not found.num_rows:
        return fit(np.empty(0, np.int64), np.zeros(1, np.int64), np.empty((0, len(PATTERNS))), np.empty(0))
    column = found["words"].combine_chunks()
    flat, ends = column.flatten().to_numpy(), np.asarray(column.offsets) - column.offsets[0].as_py()
    bits = found["patterns"].to_numpy()[:, None] >> np.arange(len(PATTERNS)) & 1
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    marks = pd.Series([flat[ends[i] : min(ends[i] + 16, ends[i + 1])].tobytes() for i in order])
    order = order[~marks.duplicated().to_numpy()]
    lengths = np.diff(ends)[order]
    take = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in order])
    return fit(flat[take], np.concatenate([[0], np.cumsum(lengths)]), bits[order].astype(float), found["toxic"].to_numpy()[order])


def fit(flat: np.ndarray, ends: np.ndarray, patterns: np.ndarray, toxic: np.ndarray, modelled: bool = True) -> Classifier:
    """Fit on rows whose word hashes are flat[ends[i]:ends[i + 1]]; not ``modelled``, on the labels themselves (to measure what the label model adds)."""
    n = len(ends) - 1
    if n == 0 or toxic.min() == toxic.max():
        # nothing to learn from: the general lexicon decides
        return Classifier({word_hash(w): 4.0 for w in LEXICON}, np.zeros(len(PATTERNS)), -3.0)
    codes, vocabulary = pd.factorize(flat)
    rows = np.repeat(np.arange(n), np.diff(ends))
    df = np.bincount(codes, minlength=len(vocabulary))
    keep = np.flatnonzero(df >= MIN_DOCS)
    column = np.full(len(vocabulary), -1)
    column[keep] = np.arange(len(keep))
    mask = column[codes] >= 0
    rows, cols, names = rows[mask], column[codes[mask]], vocabulary[keep].tolist()
    pos = np.bincount(cols, toxic[rows], len(names))
    neg = np.bincount(cols, 1 - toxic[rows], len(names))
    # lexicon voters: the general lexicon, and words whose odds are well above the rest's beyond chance
    p, q = (pos + 0.5) / (toxic.sum() + 1), (neg + 0.5) / ((1 - toxic).sum() + 1)
    sure = np.log(p / q) - 2.0 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    learned = [k for k in np.argsort(-sure * np.sqrt(pos)) if sure[k] > SURE][:VOTERS]
    lexicon = set(map(word_hash, LEXICON))
    general = [k for k, w in enumerate(names) if w in lexicon and sure[k] > 0]
    voters = list(dict.fromkeys([*learned, *general]))
    votes = np.zeros((n, len(voters) + len(PATTERNS)))
    at = {k: i for i, k in enumerate(voters)}
    for r, c in zip(rows[hit := np.isin(cols, voters)], cols[hit]):
        votes[r, at[c]] = 1
    votes[:, len(voters) :] = patterns
    start = 0.01 + 0.98 * toxic.astype(float)  # what a given label says before any vote
    model = fit_label_model(votes, start, np.ones(votes.shape[1], bool))
    chance = model.posterior(votes, start) if modelled else toxic.astype(float)
    # the classifier sees the patterns, the voters' words, and words that go with toxic rows beyond chance
    told = (sure > 0) | np.isin(np.arange(len(names)), voters)
    rows, cols = rows[told[cols]], cols[told[cols]]
    extra = np.nonzero(votes[:, len(voters) :])
    w, b = fit_linear(np.concatenate([rows, extra[0]]), np.concatenate([cols, len(names) + extra[1]]), n, len(names) + len(PATTERNS), chance)
    return Classifier({t: float(x) for t, x in zip(names, w) if abs(x) > 1e-3}, w[len(names) :], b)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.

    Labels of rows with crc32(doc_id) mod 5 = 0 are never looked at.  Null and empty texts get
    the score of a text without any word.  Null doc_ids are not held out; rows that repeat an id are
    scored each for itself; an empty table gives an empty result.  Other columns are not read.
    Without any label of both kinds the general lexicon decides.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classifier = learn(base, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = Telling(classifier.weights)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([classifier.score(t.as_py(), telling) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return base.mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
