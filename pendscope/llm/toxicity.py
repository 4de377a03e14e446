"""Toxic spans by a linear-chain conditional random field over words.

Token labels come from document labels: in toxic training documents a word is labelled toxic if one of its features (the word and
its prefixes) is found in toxic documents far more often than chance allows; all other words, and all words of
clean documents, are labelled clean. The field has two states, one weight per hashed feature and one per transition, and is
fitted by its exact likelihood. Forward and backward passes give each word's marginal; a logistic regression on the largest
marginal and their sum scores the document, and words over one half are its offending spans.

The model is fitted on the driver on at most ``TRAIN_DOCS`` labelled documents of up to ``TRAIN_CHARS`` characters, taken by
hash of their id. Scoring reads every text whole, in tasks that need nothing but the broadcast model (some 2 MB)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_DOCS = 4000
TRAIN_CHARS = 20_000
FEATURES = 1 << 18
PER_WORD = 5
ROUNDS = 40
EVIDENCE = 30.0  # log-likelihood ratio from which a feature marks toxic words
RATE = 0.8  # least share of toxic documents among those that hold the feature
THRESHOLD = 0.3
KEPT_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> tuple[int, ...]:
    raw = word.encode()
    parts = [b"w" + raw, *(b"p" + raw[:k] for k in (4, 5, 6, 7))]
    return tuple(crc32(p) % FEATURES for p in parts)


class Words(dict):
    """Word to code, with the features of every word met."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code

    def take_new(self) -> np.ndarray:
        new, self.new = self.new, []
        return np.fromiter(chain.from_iterable(map(features_of, new)), np.int64, PER_WORD * len(new)).reshape(-1, PER_WORD)


def lower(text: str | None) -> str:
    """Lower case, letter by letter: the one letter that would become two is replaced first, so that places stay places of the text."""
    return (text or "").replace("\u0130", "i").lower()


def read(words: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words in turn, and the number of words of each text."""
    split = [_WORD.findall(lower(text)) for text in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    return np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum())), sizes


def passes(ratio: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward probability of the toxic state and backward ratio at every word, for all chains at once. ``ratio``: emission
    potential of toxic against clean; ``step``: transition potentials [from, to]."""
    forward, backward = np.zeros(len(ratio)), np.ones(len(ratio))
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    starts = _starts(order, sizes)
    longest = int(sizes[0]) if len(sizes) else 0
    going = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than t
    state = np.zeros(len(sizes))
    for t in range(longest):
        k = going[t]
        at = starts[:k] + t
        toxic = ratio[at] * (state[:k] * (step[1, 1] - step[0, 1]) + step[0, 1])
        state[:k] = toxic / (toxic + state[:k] * (step[1, 0] - step[0, 0]) + step[0, 0])
        forward[at] = state[:k]
    after = np.ones(len(sizes))
    for t in range(longest - 1, 0, -1):
        k = going[t]
        at = starts[:k] + t
        seen = ratio[at] * after[:k]
        after[:k] = (step[1, 1] * seen + step[1, 0]) / (step[0, 1] * seen + step[0, 0])
        backward[at - 1] = after[:k]
    return forward, backward


def _starts(order: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """First word of each chain in ``order``, given the chains' ordered sizes."""
    plain = np.empty(len(order), np.int64)
    plain[order] = sizes
    return (np.cumsum(plain) - plain)[order]


def marginals(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    toxic = forward * backward
    return toxic / (toxic + 1 - forward)


@dataclass
class Model:
    weights: np.ndarray  # one per hashed feature
    step: np.ndarray  # transition weights [from, to]
    document: np.ndarray  # bias, largest marginal, log of 1 + sum

    def digest(self) -> str:
        return blake2b(b"".join(np.ascontiguousarray(part).tobytes() for part in (self.weights, self.step, self.document))).hexdigest()

    def emission(self, features: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.weights[features].sum(axis=1), -30, 30))

    def score(self, largest: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.document[0] + self.document[1] * largest + self.document[2] * np.log1p(total))))


def per_chain(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value and sum of each chain; 0 for empty ones."""
    largest, total = np.zeros(len(sizes)), np.zeros(len(sizes))
    held = np.nonzero(sizes)[0]
    if len(held):
        starts = (np.cumsum(sizes) - sizes)[held]
        largest[held], total[held] = np.maximum.reduceat(values, starts), np.add.reduceat(values, starts)
    return largest, total


def toxic_features(features: np.ndarray, codes: np.ndarray, sizes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Flags of the features that are evidence of toxicity by Dunning's log-likelihood ratio over documents."""
    found = np.zeros((2, FEATURES))
    for words, label in zip(np.split(codes, np.cumsum(sizes)[:-1]), toxic):
        found[label, np.unique(features[np.unique(words)])] += 1
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()], float)
    held = found.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * sum(np.where(found[k] > 0, found[k] * np.log(found[k] * n.sum() / (held * n[k])), 0) for k in (0, 1))
        return (ratio >= EVIDENCE) & (found[1] >= RATE * held)


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """The model of labelled documents. Without documents of both labels every score is the share of toxic ones."""
    toxic = np.array(toxic, np.int64)
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)), np.array([-30.0 if not toxic.any() else 30.0, 0.0, 0.0]))
    if len(set(toxic.tolist())) < 2:
        return model
    apart = np.arange(len(texts)) % 4 == 3  # these documents only calibrate the document score
    if len(set(toxic[apart].tolist())) < 2 or len(set(toxic[~apart].tolist())) < 2:
        apart[:] = False
    words = Words()
    codes, sizes = read(words, [t for t, a in zip(texts, apart) if not a])
    features = words.take_new()
    _fit_field(model, features, codes, sizes, toxic[~apart])

    if apart.any():
        codes, sizes = read(words, [t for t, a in zip(texts, apart) if a])
        features, toxic = np.concatenate([features, words.take_new()]), toxic[apart]
    forward, backward = passes(model.emission(features)[codes], sizes, np.exp(model.step))
    largest, total = per_chain(marginals(forward, backward), sizes)
    x = np.stack([np.ones(len(sizes)), largest, np.log1p(total)], axis=1)
    w = np.zeros(3)
    for _ in range(25):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (toxic - p) - 0.1 * w)
    model.document = w
    return model


def _fit_field(model: Model, features: np.ndarray, codes: np.ndarray, sizes: np.ndarray, toxic: np.ndarray) -> None:
    """Weights of features and transitions by the exact likelihood of the token labels, with adaptive steps."""
    marked = toxic_features(features, codes, sizes, toxic)[features].any(axis=1)
    labels = (marked[codes] & (np.repeat(toxic, sizes) == 1)).astype(float)
    inside = np.ones(len(codes), bool)  # words that follow another of their document
    inside[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    after = np.nonzero(inside)[0]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[after - 1].astype(int), labels[after].astype(int)), 1)
    flat = features.ravel()
    moment = [[np.zeros(FEATURES), np.zeros(FEATURES)], [np.zeros((2, 2)), np.zeros((2, 2))]]
    bias = np.log((labels.sum() + 1) / (len(labels) + 2)) / PER_WORD
    model.weights[:] = bias  # an unseen word is as rarely toxic as words are
    for turn in range(1, ROUNDS + 1):
        ratio, step = model.emission(features)[codes], np.exp(model.step)
        forward, backward = passes(ratio, sizes, step)
        p = marginals(forward, backward)
        gradient = np.bincount(flat, np.repeat(np.bincount(codes, labels - p, len(features)), PER_WORD), FEATURES) - 0.01 * (model.weights - bias)
        before = np.stack([1 - forward[after - 1], forward[after - 1]])
        here = np.stack([np.ones(len(after)), ratio[after] * backward[after]])
        pairs = before[:, None, :] * step[:, :, None] * here[None, :, :]
        expected = (pairs / pairs.sum(axis=(0, 1))).sum(axis=2)
        for value, g, (first, second) in ((model.weights, gradient, moment[0]), (model.step, seen - expected - 0.01 * model.step, moment[1])):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            value += 0.2 * (first / (1 - 0.9 ** turn)) / (np.sqrt(second / (1 - 0.99 ** turn)) + 1e-6)


def in_training(key: str):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) != 2


def fit_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of a bounded sample: labelled rows outside the held-out quarter, first by hash of their id. Only the bounded
    list of ids is broadcast and only these documents' texts reach the driver."""
    ids = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).filter(in_training(key)).groupBy(F.col(key).alias("key")).agg(
        F.max(F.col(label).cast("int")).alias("label"))
    ids = ids.orderBy(F.xxhash64("key"), "key").limit(TRAIN_DOCS)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).filter(F.length("body") <= TRAIN_CHARS).join(F.broadcast(ids), "key")
    rows = rows.groupBy("key").agg(F.first("label").alias("label"), F.max("body").alias("body")).orderBy("key").collect()
    return fit([row["body"] for row in rows], [row["label"] for row in rows])


class Scorer:
    """A model with the words its task has met; their number is bounded."""

    def __init__(self, model: Model):
        self.model, self.step = model, np.exp(model.step)
        self.words, self.emission = Words(), np.empty(0)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text, marginals of all words in turn, number of words of each text."""
        if len(self.words) > KEPT_WORDS:
            self.words, self.emission = Words(), np.empty(0)
        codes, sizes = read(self.words, texts)
        self.emission = np.concatenate([self.emission, self.model.emission(self.words.take_new())])
        p = marginals(*passes(self.emission[codes], sizes, self.step))
        return self.model.score(*per_chain(p, sizes)), p, sizes


def spans_over_half(text: str | None, p: np.ndarray) -> list[str]:
    return [f"{m.start()}:{m.end()}" for m, v in zip(_WORD.finditer(lower(text)), p) if v >= 0.5] if (p >= 0.5).any() else []


_SCORERS: dict[str, Scorer] = {}  # by the model's digest: workers outlive jobs


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``spans`` (start:end of offending words in the text, comma-joined).

    Null and empty texts have no words and get the score of no evidence; equal texts have equal scores; columns of these
    names are replaced. Rows are scored one by one, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = model.digest()
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.StringType())])

    @F.pandas_udf(kind)
    def judge(texts: pd.Series) -> pd.DataFrame:
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        scorer, scores, spans, group, size = _SCORERS[name], [], [], [], 0
        for k, text in enumerate(texts):
            group.append(text)
            size += len(text or "")
            if size > 8_000_000 or k == len(texts) - 1:  # texts worked on together
                found, p, sizes = scorer(group)
                scores.append(found)
                spans += [",".join(spans_over_half(t, q)) for t, q in zip(group, np.split(p, np.cumsum(sizes)[:-1]))]
                group, size = [], 0
        return pd.DataFrame({"score": np.concatenate(scores) if scores else np.empty(0), "spans": spans})

    kept = [c for c in docs.columns if c.lower() not in ("score", "spans", "judged")]
    return docs.select(*(F.col(f"`{c}`") for c in kept), judge(F.col(text)).alias("judged")).select(*(F.col(f"`{c}`") for c in kept), "judged.*")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    judged = score_toxicity(docs.select("doc_id", "text"), fit_on(docs, labels))
    return judged.select("doc_id", (~in_training("doc_id")).alias("held_out"), "score", F.expr(f"int(score >= {THRESHOLD})").alias("predicted"), "spans")
