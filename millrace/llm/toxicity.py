"""Toxicity (operator 7): a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios, trained on labelled text.

Features: which n-grams of code points (N_GRAMS long, lower-cased, with a space before and after the text; hashed to 2 ** BUCKET_BITS) a text has at all. r = log ratio of the
classes' smoothed document frequencies; a logistic regression with a ridge is fitted over x * r until it converges. The operating point follows from cross-validation on the rows
learned from: the least threshold at which at most FALSE_POSITIVES of the rows without the label are called toxic; scores are shifted so that it becomes 0.5.
Fitting uses at most SAMPLE labelled rows of each class, one text an id (a documented bound). Their features stream through the driver, which keeps counts and then only what has a weight.
Null, empty and very short texts have few n-grams or none and get about the score of the offset alone. Repeated rows get equal scores, an empty table gives no rows, and a column
named like the result is replaced by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import class_share, label_sample, let_go, sample_texts, stage, unstage

N_GRAMS, BUCKET_BITS, SAMPLE, ALPHA = (4, 5, 6), 20, {1: 3000, 0: 6000}, 0.5
#: Features in fewer sample rows than MIN_ROWS, or with a log-count ratio nearer to 0 than MIN_RATIO, get no weight.
MIN_ROWS, MIN_RATIO, RIDGE, FOLDS, FALSE_POSITIVES = 4, 1.5, 1e-2, 5, 0.01
# Odd multipliers of the n-gram hash.
MIX, STEP = np.uint32(0x85EBCA6B), np.uint32(16777619)
PIECE = 1 << 16


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """Code points of the whole text in pieces that overlap by the longest n-gram less one, so that memory stays bounded and none is lost."""
    whole = f" {text} " if text else ""
    for k in range(0, max(len(whole) - 1, 0), PIECE):
        yield np.frombuffer(whole[k : k + PIECE + max(N_GRAMS) - 1].lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorts x in place."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the text's n-grams."""
    out: list[np.ndarray] = []
    shift = np.uint32(32 - BUCKET_BITS)
    for b in pieces(text):
        h, own = np.zeros(len(b), np.uint32), []
        for n in range(1, min(len(b), max(N_GRAMS)) + 1):
            h = h[: len(b) - n + 1] * STEP
            h += b[n - 1 :]
            h += np.uint32(1)
            if n in N_GRAMS:
                x = h ^ (h >> np.uint32(15))
                x *= MIX
                x ^= x >> np.uint32(13)
                x >>= shift
                own.append(x)
        if own:
            out.append(distinct(np.concatenate(own)))
    return (out[0] if len(out) == 1 else distinct(np.concatenate(out)) if out else np.zeros(0, np.uint32)).view(np.int32)


@dataclass
class Model:
    """Weights of the buckets in ids (sorted), all others have none."""

    ids: np.ndarray
    weights: np.ndarray
    offset: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BUCKET_BITS, np.float32)
        out[self.ids] = self.weights
        return out

    def scores(self, texts, table: np.ndarray | None = None) -> np.ndarray:
        table = self.table() if table is None else table
        z = np.fromiter((table[features(t)].sum() for t in texts), float, len(texts)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ratios(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed document frequencies. seen: [class, feature], n: rows of each class."""
    return np.log((seen[1] + ALPHA) / (n[1] + 2 * ALPHA)) - np.log((seen[0] + ALPHA) / (n[0] + 2 * ALPHA))


def minimise(f, x: np.ndarray, steps: int = 300, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving; f gives value and gradient. Ends when neither moves any more."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, back = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            back.append(a)
        q *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(pairs, reversed(back)):
            q += s * (a - (y @ q) / (s @ y))
        step, down = 1.0, g @ q
        while True:
            new, g_new = f(x - step * q)
            if new <= value - 1e-4 * step * down or step < 1e-8:
                break
            step /= 2
        s, y = -step * q, g_new - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        still = abs(value - new) < 1e-7 * max(abs(value), 1e-3)
        x, value, g = x + s, new, g_new
        if still or np.abs(g).max() < 1e-6:
            break
    return x


def train(rows: list[np.ndarray], y: np.ndarray, share: float, ridge: float = RIDGE) -> Model:
    """Ridge logistic regression over x * r with both classes of equal weight."""
    none = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return none
    flat, owner = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), list(map(len, rows)))
    ids, col = np.unique(flat, return_inverse=True)
    seen = np.stack([np.bincount(col[y[owner] == c], minlength=len(ids)) for c in (0, 1)])
    r = ratios(seen, np.array([(y == 0).sum(), (y == 1).sum()]))
    keep = (seen.sum(0) >= MIN_ROWS) & (np.abs(r) > MIN_RATIO)
    if not keep.any():
        return none
    at = keep[col]
    to = np.cumsum(keep) - 1
    col, owner, ids, r = to[col[at]], owner[at], ids[keep], r[keep]
    val, k = r[col], len(ids)
    cw = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / len(y)
    sign = 2 * y - 1

    def loss(t: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = t[:-1], t[-1]
        z = np.bincount(owner, val * w[col], len(y)) + b
        g = cw * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        return float((cw * np.logaddexp(0, -sign * z)).sum() + ridge / 2 * (w @ w)), np.append(np.bincount(col, val * g[owner], k) + ridge * w, g.sum())

    t = minimise(loss, np.zeros(k + 1))
    return Model(ids, (t[:-1] * r).astype(np.float32), float(t[-1]))


def margins(rows: list[np.ndarray], y: np.ndarray, share: float) -> np.ndarray:
    """Of each row, from a model that hasn't seen it."""
    out = np.zeros(len(y))
    for k in range(FOLDS):
        own = np.arange(len(y)) % FOLDS == k
        m = train([x for x, o in zip(rows, own, strict=True) if not o], y[~own], share)
        table = m.table()
        for j in np.flatnonzero(own):
            out[j] = table[rows[j]].sum() + m.offset
    return out


def operating_point(z: np.ndarray, y: np.ndarray, false_positives: float = FALSE_POSITIVES) -> float:
    """The least threshold that keeps to the share of false positives, half-way to the next row above it that has the label."""
    others = np.sort(z[y == 0])[::-1]
    low = float(others[min(int(len(others) * false_positives), len(others) - 1)])
    above = z[(y == 1) & (z > low)]
    return (low + float(above.min())) / 2 if len(above) else low


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: dict[int, int] = SAMPLE, seed: int = 23) -> Model:
    """labels: the rows that may be learned from."""
    picked = label_sample(labels, column, sample, seed)
    share = class_share(labels, column)
    if len({c for _, c in picked}) < 2:
        return train([], np.array([c for _, c in picked], int), share)

    @F.pandas_udf("binary")
    def get(texts: pd.Series) -> pd.Series:
        let_go()
        return texts.map(lambda t: features(t).tobytes())

    rows = stage(sample_texts(docs, picked).select("id", "y", get("text").alias("f")), "toxicity-features")
    seen, n = np.zeros((2, 1 << BUCKET_BITS), np.int32), np.zeros(2, np.int64)
    for r in rows.toLocalIterator():  # a file or a part of one at a time
        seen[r.y, np.frombuffer(r.f, np.int32)] += 1
        n[r.y] += 1
    if n.min() == 0:
        unstage(rows)
        return train([], np.zeros(0, int), share)
    # with a margin, as the folds' ratios differ a little
    may = (seen.sum(0) >= MIN_ROWS) & (np.abs(ratios(seen, n)) > MIN_RATIO - 0.5)
    got = sorted(((r.id, r.y, (x := np.frombuffer(r.f, np.int32))[may[x]]) for r in rows.toLocalIterator()), key=lambda r: r[0])
    unstage(rows)
    order = np.argsort([zlib.crc32(f"{seed} {i}".encode()) for i, _, _ in got], kind="stable")
    xs, y = [got[k][2] for k in order], np.array([got[k][1] for k in order])
    m = train(xs, y, share)
    if min(n) >= FOLDS and len(m.ids):
        m.offset -= operating_point(margins(xs, y, share), y)
    return m


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """Adds the probability of label 1. The weights are a broadcast variable of 8 MB at most."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        let_go()
        model = held.value
        table = model.table()
        for texts in batches:
            yield pd.Series(model.scores(texts, table))

    return docs.withColumn(into, run.asNondeterministic()(F.col("text").cast("string")))
