"""Quality classifier (operator 10): two zstandard dictionaries, one built from good and one from bad labelled text; the normalised difference of the compressed sizes becomes a calibrated score.

Every text is cut into blocks of BLOCK bytes over its whole length, so that the dictionaries bear on all of it, and each block is compressed with both. The difference of
the sizes is divided by the text's own length, so words repeated without end, which both dictionaries compress to nothing, differ by nothing and fall with the bad ones.
Fitting uses at most SAMPLE labelled rows of each class, one text an id, and BLOCKS_PER_DOC blocks of each (documented bounds); half of those rows build the dictionaries,
the other half calibrate. Null and empty texts have difference 0 and get the calibrated score of 0. With no labels of one class the score is the share of label 1.
Repeated rows get equal scores, an empty table gives no rows, and a column named like the result is replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import class_share, label_sample, let_go, sample_texts, stage, unstage

SAMPLE, BLOCKS_PER_DOC, BLOCK, DICT_BYTES, LEVEL = 2000, 64, 2048, 112 * 1024, 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    beta: tuple[float, float]

    def scorer(self):
        """For a text: the compressed-size difference over its length, above 0 if the good dictionary fits better."""
        if not self.good or not self.bad:
            return lambda text: 0.0
        packs = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            packs.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        good, bad = packs

        def difference(text: str | None) -> float:
            raw = memoryview((text or "").encode("utf-8", "surrogatepass"))
            g = b = 0
            for k in range(0, len(raw), BLOCK):
                part = raw[k : k + BLOCK]
                g += len(good.compress(part))
                b += len(bad.compress(part))
            return (b - g) / len(raw) if len(raw) else 0.0

        return difference

    def probability(self, d: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(d * self.beta[0] + self.beta[1], -30, 30)))


def blocks(text: str | None, n: int = BLOCKS_PER_DOC) -> list[bytes]:
    """n blocks spread evenly over the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    total = -(-len(raw) // BLOCK)
    picked = range(total) if total <= n else [int((k + 0.5) * total / n) for k in range(n)]
    return [raw[k * BLOCK : (k + 1) * BLOCK] for k in picked]


def spread(samples: list[bytes], size: int) -> bytes:
    """size bytes at most, of all samples alike."""
    each = max(8, size // max(len(samples), 1))
    return b"".join(x[:each] for x in samples)[:size]


def dictionary(samples: list[bytes]) -> bytes:
    samples = [s for s in samples if len(s) >= 8]
    if sum(map(len, samples)) < 20 * 1024:
        return zstandard.ZstdCompressionDict(spread(samples, DICT_BYTES), dict_type=zstandard.DICT_TYPE_RAWCONTENT).as_bytes()
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=128, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # samples too few or too alike for training
        return spread(samples, DICT_BYTES)


def calibrate(d: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-4) -> tuple[float, float]:
    """Logistic regression of y on the difference by Newton steps, with the classes weighted to the given share of label 1."""
    if len(set(y.tolist())) < 2:
        return 0.0, math.log(share / (1 - share))
    w = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean()) / len(y)
    scale = max(float(d.std()), 1e-9)
    x = np.column_stack([d / scale, np.ones(len(d))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE, seed: int = 17) -> Model:
    """labels: the rows that may be learned from. To the driver come at most 2 * sample * BLOCKS_PER_DOC blocks and as many differences as rows."""
    picked = label_sample(labels, column, {0: sample, 1: sample}, seed)
    share = class_share(labels, column)
    if len({c for _, c in picked}) < 2:
        return Model(b"", b"", (0.0, math.log(share / (1 - share))))
    texts = stage(sample_texts(docs, picked).withColumn("half", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(2))), "quality-sample")

    @F.pandas_udf("array<binary>")
    def cut(t: pd.Series) -> pd.Series:
        let_go()
        return t.map(blocks)

    rows = texts.where("half = 0").select("id", "y", cut("text").alias("b")).collect()
    rows.sort(key=lambda r: r.id)
    seen: dict[int, dict[bytes, None]] = {0: {}, 1: {}}
    for r in rows:
        seen[r.y].update(dict.fromkeys(map(bytes, r.b)))
    m = Model(dictionary(list(seen[1])), dictionary(list(seen[0])), (0.0, 0.0))

    @F.pandas_udf("double")
    def differ(t: pd.Series) -> pd.Series:
        return pd.Series(list(map(m.scorer(), t)), dtype=float)

    got = texts.where("half = 1").select(differ("text").alias("d"), "y").collect()
    unstage(texts)
    m.beta = calibrate(np.array([r.d for r in got], float), np.array([r.y for r in got], int), share)
    return m


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """Adds the probability of label 1. The model (two dictionaries of DICT_BYTES) goes with the function."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        let_go()
        return pd.Series(model.probability(np.fromiter(map(model.scorer(), texts), float, len(texts))))

    return docs.withColumn(into, run.asNondeterministic()(F.col("text").cast("string")))
