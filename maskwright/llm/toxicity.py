"""Toxic spans by a linear-chain conditional random field over words.

Two states, clean and toxic. A word's emission is a bias plus the weights of its
features: the word itself and its prefixes of 3 to 8 letters. Token labels for
training come from document labels: a word of a toxic training document is toxic
if one of its features occurs almost only in toxic training documents. The field
is fitted by gradient ascent on the conditional likelihood (forward-backward),
on a bounded sample: at most ``per_label`` documents of each label, spread by
hash, none longer than ``max_train_chars`` (documented bounds of the fit only;
scoring reads every whole text).

Scoring runs forward-backward over all words of a text. A document's score is the
largest toxic marginal of its words; offending offsets are the code point spans of
words with a marginal of 0.5 or more.

Results by case: a null or empty text, or one without words, scores 0; null ids and repeated rows are scored like any other row and are never
learnt from; conflicting labels of one id count as toxic; without toxic training
rows every score is 0; empty tables give empty results; only the named columns
are read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from maskwright.llm.common import bucket_sample, held_out, map_rows

WORD = re.compile(r"\w+")
PREFIXES = range(3, 9)
#: A feature is evidence if this many toxic training texts have it, this share of
#: them at least, and its smoothed share there is this many times that in clean ones.
MIN_SUPPORT, MIN_SHARE, MIN_RATIO = 6, 0.015, 40.0
MAX_FEATURES = 20_000
PER_TOXIC, PER_CLEAN, MAX_TRAIN_CHARS = 1_500, 4_500, 12_000
CACHE_WORDS = 150_000


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


@dataclass
class Field:
    """Feature weights, bias and the 2 x 2 transition scores (log)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    trans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)


class Emissions(dict):
    """word -> emission log-odds, filled as words are met, emptied when it is large."""

    def __init__(self, model: Field):
        super().__init__()
        self.weights, self.bias = model.weights, model.bias

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        get = self.weights.get
        u = self.bias + sum(get(f, 0.0) for f in word_features(word))
        self[word] = u
        return u


def _distinct_texts(texts: list[str]) -> list[str]:
    """Drop near copies from the training sample: texts that share a rare minimum hash."""
    kept, seen = [], set()
    for text in texts:
        words = WORD.findall(text.lower())
        grams = {xxh64_intdigest(" ".join(g)) for g in zip(words, words[1:], words[2:], strict=False)} or {xxh64_intdigest(" ".join(words))}
        keys = {("a", min(grams)), ("b", max(grams)), ("c", min(g ^ 0x5555555555555555 for g in grams))}
        if not keys & seen:
            kept.append(text)
        seen |= keys
    return kept


class _Known(dict):
    """word -> its features that are in ``among`` (all features where that is None)."""

    def __init__(self, among=None):
        super().__init__()
        self.among = among

    def __missing__(self, word: str) -> list[str]:
        found = word_features(word)
        self[word] = found = found if self.among is None else [f for f in found if f in self.among]
        return found


def _document_counts(texts: list[str], known: _Known) -> Counter:
    counts: Counter = Counter()
    for text in texts:
        counts.update({f for w in set(WORD.findall(text.lower())) for f in known[w]})
    return counts


def select_features(toxic: list[str], clean: list[str]) -> set[str]:
    least = max(MIN_SUPPORT, math.ceil(MIN_SHARE * len(toxic)))
    counts = {f: k for f, k in _document_counts(toxic, _Known()).items() if k >= least}
    other = _document_counts(clean, _Known(counts))
    share = lambda f: (counts[f] / len(toxic)) / ((other[f] + 0.25) / max(1, len(clean)))
    good = [f for f in counts if share(f) >= MIN_RATIO]
    return set(sorted(good, key=lambda f: (-counts[f], f))[:MAX_FEATURES])


def forward_backward(u: np.ndarray, lengths: np.ndarray, trans: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Marginals P(toxic) and pair marginals [.., 4] of padded emission log-odds."""
    a, b, c, d = trans
    n, t = u.shape
    f = np.zeros((n, t))  # log-odds of the forward messages, emission included
    g = np.zeros((n, t))  # log-odds of the backward messages
    f[:, 0] = u[:, 0]
    for i in range(1, t):
        x = f[:, i - 1]
        f[:, i] = np.logaddexp(b, d + x) - np.logaddexp(a, c + x) + u[:, i]
    for i in range(t - 2, -1, -1):
        x = g[:, i + 1] + u[:, i + 1]
        g[:, i] = np.where(i < lengths - 1, np.logaddexp(c, d + x) - np.logaddexp(a, b + x), 0.0)
    p = 1 / (1 + np.exp(-np.clip(f + g, -500, 500)))
    x, y = f[:, :-1], (g + u)[:, 1:]
    pair = np.stack([a + 0 * x, b + y, c + x, d + x + y], -1)
    pair -= pair.max(-1, keepdims=True)
    pair = np.exp(pair)
    pair /= pair.sum(-1, keepdims=True)
    pair[np.arange(t - 1)[None, :] >= lengths[:, None] - 1] = 0
    return p, pair


def fit(toxic: list[str], clean: list[str], steps: int = 60, window: int = 40, ridge: float = 0.02) -> Field:
    """Fit the field. Texts are cut into windows of words, whose gradients are summed."""
    toxic, clean = _distinct_texts(toxic), _distinct_texts(clean)
    features = select_features(toxic, clean)
    if not features:
        return Field()
    index = {f: i for i, f in enumerate(sorted(features))}
    known = _Known(index)
    rows: list[tuple[list[list[int]], int]] = []
    plain = 0  # windows without any feature are all alike: one row with a weight for each length
    for y, texts in ((1, toxic), (0, clean)):
        for text in texts:
            ids = [[index[f] for f in known[w]] for w in WORD.findall(text.lower())]
            for i in range(0, len(ids), window):
                part = ids[i : i + window]
                if any(part):
                    rows.append((part, y))
                else:
                    plain += 1
    rows.append(([[]] * window, 0))
    weight = np.array([1.0] * (len(rows) - 1) + [max(1, plain)])
    lengths = np.array([len(r) for r, _ in rows])
    at = np.array([(i, t, f) for i, (r, _) in enumerate(rows) for t, fs in enumerate(r) for f in fs])
    y = np.zeros((len(rows), window))
    y[at[:, 0], at[:, 1]] = np.array([label for _, label in rows])[at[:, 0]]
    mask = np.arange(window)[None, :] < lengths[:, None]
    pairs = y[:, :-1] * 2 + y[:, 1:]
    seen = np.stack([((pairs == k) & mask[:, 1:]) * weight[:, None] for k in range(4)], -1).sum((0, 1))
    theta = np.zeros(len(index) + 5)
    theta[len(index)] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum()
    for step in range(1, steps + 1):
        w, bias, trans = theta[: len(index)], theta[len(index)], tuple(theta[len(index) + 1 :])
        u = np.full(y.shape, bias)
        np.add.at(u, (at[:, 0], at[:, 1]), w[at[:, 2]])
        p, pair = forward_backward(u, lengths, trans)
        gap = (y - p) * mask * weight[:, None]
        grad = np.empty_like(theta)
        grad[: len(index)] = np.bincount(at[:, 2], gap[at[:, 0], at[:, 1]], len(index)) - ridge * w
        grad[len(index)] = gap.sum() / total
        grad[len(index) + 1 :] = (seen - (pair * weight[:, None, None]).sum((0, 1))) / total
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in index.items()}, float(theta[len(index)]), tuple(map(float, theta[len(index) + 1 :])))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """Fit on the labelled rows whose id is not held out; the sample is bounded, see the module."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    short = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") <= MAX_TRAIN_CHARS)
    short = short.withColumn("key", F.xxhash64("doc_id", "text"))
    rows = short.select("doc_id", "key").join(known, "doc_id")  # texts are not shuffled
    keys = bucket_sample(rows.where("y = 1"), "y", F.col("key"), PER_TOXIC).unionByName(bucket_sample(rows.where("y = 0"), "y", F.col("key"), PER_CLEAN))
    sample = short.join(F.broadcast(keys), "key").select("label", "key", "text")  # at most PER_TOXIC + PER_CLEAN keys
    texts = sample.dropDuplicates(["label", "key"]).collect()  # repeated rows once
    by = {y: sorted(r["text"] for r in texts if r["label"] == y) for y in (0, 1)}
    return fit(by[1], by[0])


class Scorer:
    """Exact marginals of one text in time that depends on the words with features only.

    Between two such words all emissions are the bias, so the chain's messages over
    a stretch of plain words are a power of one 2 x 2 matrix. Along a stretch the marginal is
    A r^k + B r^-k + C for the ratio r of the matrix's eigenvalues, so its largest value lies at
    an end of the stretch or where the two terms are alike.
    """

    def __init__(self, model: Field):
        self.bias, self.emissions = model.bias, Emissions(model)
        a, b, c, d = model.trans
        self.trans = np.exp(np.array([[a, b], [c, d]]) - max(a, b, c, d))
        plain = self.trans * np.exp(np.array([0.0, model.bias]))[None, :]
        self.plain = plain / max(plain.max(), 1e-300)
        self.start = np.array([1.0, math.exp(self.bias)])
        self.start /= self.start.sum()
        values, vectors = np.linalg.eig(self.plain)
        order = np.argsort(-np.abs(values))
        self.vectors = np.real(vectors[:, order])
        self.rows = np.linalg.pinv(self.vectors)
        self.ratio = float(np.real(values[order[1]] / values[order[0]]))
        self.powers: dict[int, np.ndarray] = {0: np.eye(2)}
        self.tops: dict[int, float] = {}

    def power(self, n: int) -> np.ndarray:
        """The plain matrix to the n, scaled. Only short stretches and powers of two are kept."""
        if n in self.powers:
            return self.powers[n]
        if n < 4096 or n & (n - 1) == 0:
            half = self.power(n // 2)
            out = half @ half @ (self.plain if n % 2 else np.eye(2))
            self.powers[n] = out / out.sum()
            return self.powers[n]
        high = 1 << (n.bit_length() - 1)
        out = self.power(high) @ self.power(n - high)
        return out / out.sum()

    def _stretch_top(self, f: np.ndarray, g: np.ndarray, n: int) -> float:
        """The largest marginal of n plain words; f is the message at the first, g that behind the last."""
        last = n - 1
        places = {0, 1, last // 2, last - 1, last}
        a = float(f @ self.vectors[:, 1] * self.rows[1, 1] * self.vectors[1, 0] * (self.rows[0] @ g))
        b = float(f @ self.vectors[:, 0] * self.rows[0, 1] * self.vectors[1, 1] * (self.rows[1] @ g))
        r = abs(self.ratio)
        if 0 < r < 1:
            # with a negative ratio even and odd words change signs on their own
            for first in (0, 1) if self.ratio < 0 else (0,):
                x, y = (a * (-1) ** first, b * (-1) ** (last - first)) if self.ratio < 0 else (a, b)
                if x < 0 and y < 0:  # the middle is above both ends
                    k = int((last + math.log(y / x) / math.log(r)) / 2)
                    places |= {k - 1, k, k + 1, k + 2}
        top = 0.0
        for k in places:
            if 0 <= k < n:
                x = (f @ self.power(k)) * (self.power(last - k) @ g)
                top = max(top, float(x[1] / x.sum()))
        return top

    def marginals(self, u: list[float]) -> tuple[list[int], list[float], float]:
        """(places of words with features, their marginals, the largest marginal of all words)."""
        if not u:
            return [], [], 0.0
        at = [i for i, x in enumerate(u) if x != self.bias]
        n, t = len(u), self.trans
        if not at:
            if n not in self.tops:
                if len(self.tops) > CACHE_WORDS:
                    self.tops.clear()
                self.tops[n] = self._stretch_top(self.start, np.ones(2), n)
            return [], [], self.tops[n]
        e = [np.exp(np.array([min(0.0, -u[i]), min(0.0, u[i])])) for i in at]
        fwd, f, before, first = [], None, -1, []  # first: the message at the first plain word behind a featured one
        plain = np.array([1.0, math.exp(self.bias)])
        for i, x in zip(at, e, strict=True):
            gap = i - before - 1
            if f is None:
                first.append(self.start)
                f = x if i == 0 else (self.start @ self.power(i - 1) @ t) * x
            else:
                first.append((f @ t) * plain)
                f = (f @ self.power(gap) @ t) * x
            f = f / f.sum()
            fwd.append(f)
            before = i
        out, top = [0.0] * len(at), 0.0
        behind, after = np.ones(2), n  # the message behind the word before ``after``
        tail = (f @ t) * plain
        for k in range(len(at) - 1, -1, -1):
            gap = after - at[k] - 1
            if gap:
                top = max(top, self._stretch_top(tail, behind, gap))
            g = self.power(gap) @ behind
            g = g / g.sum()
            p = fwd[k] * g
            out[k] = float(p[1] / p.sum())
            behind, after, tail = t @ (e[k] * g), at[k], first[k]
        if at[0]:
            top = max(top, self._stretch_top(self.start, behind, at[0]))
        return at, out, max(top, *out)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(document score, toxic spans in code points)."""
        low = (text or "").lower()
        places, marginal, top = self.marginals(list(map(self.emissions.__getitem__, WORD.findall(low))))
        bad = {i: p for i, p in zip(places, marginal, strict=True) if p >= 0.5}
        if not bad:
            return top, []
        # lower() may change the length of a few letters, so spans come from the text itself
        words = WORD.finditer(text if len(low) == len(text) else low)
        return top, [(m.start(), m.end(), bad[i]) for i, m in enumerate(words) if i in bad]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def score_toxicity(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, spans (start, end, p)."""
    run, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def fn(batch: pa.RecordBatch):
        scorer = _scorer(run, shared)
        done = [scorer.score(t) for t in batch.column(1).to_pylist()]
        spans = [[{"start": s, "end": e, "p": p} for s, e, p in x] for _, x in done]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in done], pa.float64()), pa.array(spans, _SPANS)], ["doc_id", "score", "spans"])

    return map_rows(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>",
        fn,
    )


_SCORERS: dict[str, Scorer] = {}


def _scorer(run: str, shared) -> Scorer:
    """One scorer for each run in a worker, so the word cache outlives a batch and a task."""
    if run not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[run] = Scorer(shared.value)
    return _SCORERS[run]


def drop_toxic(docs: DataFrame, model: Field, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is below ``threshold``, all columns as they are."""
    run, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def fn(batch: pa.RecordBatch):
        scorer = _scorer(run, shared)
        yield batch.filter(pa.array([scorer.score(t)[0] < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_rows(docs, docs.schema, fn)
