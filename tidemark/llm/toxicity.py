"""Operator 6: a chain of linear classifiers over toxicity categories.

Each category has a logistic model on the words that a text holds, scaled by their
log-odds in the labelled sample.  Categories are predicted in order: a later model also
takes the logits of all earlier ones.  In training these come from models that did not
see the document (out of fold), so a later model learns how far the earlier ones can be
trusted on new text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_ddl, filter_batches, map_batches
from .contamination import terms

#: Columns of the hashed vocabulary.
WIDTH = 1 << 20
#: Labelled documents that a fit uses at most; with more, a share of the ids by hash is taken.
MOST_LABELLED = 8_000
#: Documents of the sample that must hold a word before it counts.
LEAST_DOCS = 3
FOLDS = 3
#: Made-up negatives beside half a positive that a base rate is smoothed with: no evidence is far from a rejection.
PRIOR_NEGATIVES = 9.5
PENALTY = 0.5
#: Word columns kept per worker, some 100 bytes each; only speed depends on it.
MEMO = 60_000


class _Columns(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        got = self[word] = xxhash.xxh32_intdigest(word) & (WIDTH - 1)
        return got


_columns = _Columns()


def word_columns(text: str | None) -> np.ndarray:
    """Columns of the distinct words of a text (ASCII letters in lower case)."""
    return np.array(list(map(_columns.__getitem__, set(terms(text)))), np.int32)


@dataclass
class Linear:
    """Weights by word column, for earlier logits, and the intercept."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    names: list[str] = field(default_factory=list)
    models: list[Linear] = field(default_factory=list)

    def logits(self, columns: np.ndarray) -> list[float]:
        out: list[float] = []
        for m in self.models:
            out.append(float(m.words[columns].sum() + m.bias + np.dot(m.earlier, out)))
        return out


def _minimise(value, x: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    f, g = value(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, used = g.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * s.dot(q)
            q -= a * y
            used.append(a)
        if steps:
            s, y, _ = steps[-1]
            q *= s.dot(y) / y.dot(y)
        for (s, y, rho), a in zip(steps, reversed(used), strict=True):
            q += (a - rho * y.dot(q)) * s
        slope, step = -g.dot(q), 1.0 if steps else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        for _ in range(30):
            nx = x - step * q
            nf, ng = value(nx)
            if nf <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = nx - x, ng - g
        if s.dot(y) > 1e-12:
            steps = [*steps[-(memory - 1) :], (s, y, 1.0 / s.dot(y))]
        done = f - nf < 1e-7 * max(1.0, abs(f))
        x, f, g = nx, nf, ng
        if done:
            break
    return x


def fit_linear(rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, penalty: float = PENALTY, least_docs: int = LEAST_DOCS) -> Linear:
    """Fit one category.  Without both classes the model is the base rate, smoothed towards 0.05, which an empty sample gives."""
    n, pos = len(y), float(y.sum())
    words = np.zeros(WIDTH, np.float32)
    if n == 0 or pos in (0.0, float(n)):
        return Linear(words, np.zeros(earlier.shape[1]), float(np.log((pos + 0.5) / (n - pos + PRIOR_NEGATIVES))))
    # only columns that the sample has are counted: memory goes by the sample's words, not by the width
    flat = np.concatenate(rows)
    of = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    seen, col, docs = np.unique(flat, return_inverse=True, return_counts=True)
    with_pos = np.bincount(col, weights=y[of], minlength=len(seen))
    odds = np.log((with_pos + 0.5) / (pos + 1)) - np.log((docs - with_pos + 0.5) / (n - pos + 1))
    often = docs >= least_docs
    active, scale = seen[often], odds[often]
    place = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)[col]
    col, of = place[place >= 0], of[place >= 0]
    del flat, seen, place
    k, e = len(active), earlier.shape[1]

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        v = scale * w[:k]
        z = np.bincount(of, weights=v[col], minlength=n) + earlier @ w[k : k + e] + w[-1]
        loss = np.logaddexp(0, z).sum() - (y * z).sum() + penalty / 2 * (w[:-1] ** 2).sum()
        d = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        grad = np.concatenate([scale * np.bincount(col, weights=d[of], minlength=k) + penalty * w[:k], earlier.T @ d + penalty * w[k : k + e], [d.sum()]])
        return loss / n, grad / n

    w = _minimise(value, np.concatenate([np.zeros(k + e), [np.log(pos / (n - pos))]]))
    words[active] = scale * w[:k]
    return Linear(words, w[k : k + e], float(w[-1]))


def fit_chain(rows: list[np.ndarray], labels: dict[str, np.ndarray], folds: np.ndarray, penalty: float = PENALTY) -> Chain:
    """Fit all categories in order; a label that is NaN leaves its document out of that category."""
    chain = Chain()
    earlier = np.zeros((len(rows), 0))
    for k, (name, y) in enumerate(labels.items()):
        has = ~np.isnan(y)
        pick = lambda mask: [rows[i] for i in np.flatnonzero(mask)]
        whole = fit_linear(pick(has), y[has], earlier[has], penalty)
        if k + 1 < len(labels):
            out = np.zeros(len(rows))
            for f in range(FOLDS):
                inside = has & (folds != f)
                m = fit_linear(pick(inside), y[inside], earlier[inside], penalty)
                for i in np.flatnonzero(folds == f):
                    out[i] = m.words[rows[i]].sum() + m.bias + m.earlier @ earlier[i]
            earlier = np.column_stack([earlier, out])
        chain.names.append(name)
        chain.models.append(whole)
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], most: int, key: str, text: str) -> DataFrame:
    """At most about ``most`` labelled texts, by a hash of their ids: the share is set by the number of labels.

    Labels of one id, and ids of one text, are averaged and rounded, so copies weigh once.
    """
    one = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(*(F.avg(c).alias(c) for c in categories))
    n = labels.select(key).count()
    if n > most:
        one = one.where(F.pmod(F.xxhash64(F.lit("fit"), F.col("_key").cast("string")), F.lit(1 << 20)) < (most << 20) // n)
    joined = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(one), F.col(key) == F.col("_key"))  # bounded by ``most``
    return joined.groupBy(F.xxhash64("text").alias("print")).agg(F.first("text").alias("text"), *(F.round(F.avg(c)).cast("double").alias(c) for c in categories))


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], most: int = MOST_LABELLED, key: str = "doc_id", text: str = "text") -> Chain:
    """Fit the chain on a bounded sample of labelled documents; the sample's word columns reach the driver, not its texts."""
    sample = labelled_sample(docs, labels, categories, most, key, text)

    def start():
        def each(b: dict[str, list]) -> dict[str, list]:
            return {c: b[c] for c in ("print", *categories)} | {"columns": [word_columns(x).tolist() for x in b["text"]]}

        return each

    schema = "print bigint, " + ", ".join(f"`{c}` double" for c in categories) + ", columns array<int>"
    got = map_batches(sample, ["print", *categories, "text"], schema, start).orderBy("print").toPandas()
    rows = [np.asarray(x, np.int32) for x in got["columns"]]
    folds = np.array([xxhash.xxh32_intdigest(str(p)) % FOLDS for p in got["print"]], np.int64)
    return fit_chain(rows, {c: got[c].to_numpy(float) for c in categories}, folds)


def score(docs: DataFrame, chain: Chain, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` columns and the probability ``p_<category>`` of each category, for every whole text.

    A null or empty text has no words and gets the chain's base probabilities; repeated rows are scored alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def start():
        c = sent.value

        def each(b: dict[str, list]) -> dict[str, list]:
            z = np.array([c.logits(word_columns(x)) for x in b[text]]).reshape(len(b[text]), len(c.names))
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            return {k: b[k] for k in carry} | {f"p_{n}": p[:, i].tolist() for i, n in enumerate(c.names)}

        return each

    kept = "".join(f"`{c}` {field_ddl(docs, c)}, " for c in carry)
    return map_batches(docs, list(dict.fromkeys([*carry, text])), kept + ", ".join(f"`p_{n}` double" for n in chain.names), start)


def clean(docs: DataFrame, chain: Chain, category: str = "toxic", below: float = 0.5, text: str = "text") -> DataFrame:
    """The documents whose probability of ``category`` is under ``below``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    at, most = chain.names.index(category), float(np.log(below / (1 - below)))

    def start():
        c = sent.value
        return lambda b: [c.logits(word_columns(x))[at] < most for x in b[text]]

    return filter_batches(docs, [text], start)


def categorised(labels: DataFrame) -> DataFrame:
    """The two categories that the labels table marks: low quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))
