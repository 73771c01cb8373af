"""Quality rules by weak supervision (operator 9): rules vote good or bad or abstain, expectation-maximisation estimates how each votes per class, and the posterior decides.

Rules that look at the same thing don't vote independently. They form a family, and the model has one table of joint votes for each family, so that two rules which
always agree count once. The share of good texts has a Beta prior (PRIOR), each joint vote a pseudo-count. The vote patterns are counted over all rows; only these
counts reach the driver (3 to the number of rules at most, at any input size; in practice some hundreds).
A text that is null or without words has no words, fails the base rules and isn't kept. Repeated rows give repeated results; of an empty table nothing comes.
The measured columns are made under names of their own, so columns of docs with such names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import let_go, stage

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_top", "n_clean", "n_short", "n_caps", "n_closed", "n_shout", "n_bytes", "n_packed"]
BASE = ", ".join(f"{x} bigint" for x in NAMES)
SPACE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
#: Beta prior of the share of good texts, and the pseudo-count of each joint vote.
PRIOR, PSEUDO = (9.0, 1.0), 1.0
PIECE = 1 << 18

# Classes of code points below 256; above, all but spaces count as letters without case.
_KIND = np.zeros(256, np.uint8)
_UPPER, _LOWER, _POINT, _END, _BLANK = 1, 2, 4, 8, 16
_KIND[[*range(65, 91), *(k for k in range(0xC0, 0xDF) if k != 0xD7)]] = _UPPER
_KIND[[*range(97, 123), *(k for k in range(0xDF, 0x100) if k != 0xF7)]] = _LOWER
_KIND[[ord(c) for c in ",;:\"'()-«»"]] = _POINT
_KIND[[ord(c) for c in ".!?"]] = _POINT | _END
_KIND[[ord(c) for c in SPACE]] = _BLANK


def repeat_words(a: np.ndarray, v: int) -> int:
    """Words within 3-word windows that the text has twice or more, the first included. a: word numbers below v."""
    if len(a) < 4:
        return 0
    if v < 2_000_000:
        tri = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:
        two = np.unique(a[:-1] * v + a[1:], return_inverse=True)[1]
        tri = two[:-1].astype(np.int64) * v + a[2:]
    order = np.argsort(tri, kind="stable")
    s = tri[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(tri), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(a), bool)
    for k in range(3):
        cover[k : k + len(tri)] |= twice
    return int(cover.sum())


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that end at a space, so that no word is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in SPACE:
            end += 1
        yield text[at:end]
        at = end


def shapes(text: str) -> np.ndarray:
    """Words of letters and punctuation alone, those of them with one to three letters, words in capitals, and those that end a sentence."""
    out = np.zeros(4, np.int64)
    for p in pieces(text):
        code = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(code < 256, _KIND[np.minimum(code, 255)], 32).astype(np.uint8)
        blank = kind == _BLANK
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            continue
        per = lambda mask: (s := np.concatenate([[0], np.cumsum(mask)]))[end] - s[start]
        upper, lower, other = per(kind == _UPPER), per(kind == _LOWER), per(kind == 0)
        letters = upper + lower + per(kind == 32)
        clean = (letters > 0) & (other == 0)
        out += clean.sum(), (clean & (letters <= 3)).sum(), ((upper >= 2) & (lower == 0)).sum(), ((kind[end - 1] & _END) > 0).sum()
    return out


def counts(text: str | None) -> tuple[int, ...]:
    """NAMES of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes, split() knows just the six ASCII spaces
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    packer, packed = zlib.compressobj(1), 0
    for k in range(0, len(raw), 1 << 20):
        packed += len(packer.compress(raw[k : k + (1 << 20)]))
    packed += len(packer.flush())
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(a, len(ids)), len(lines),
            len(ids), int(np.bincount(a).max()) if len(a) else 0, *map(int, shapes(text)), text.count("!!"), len(raw), packed)


def measure(docs: DataFrame, text: str = "text", into: str = "_base") -> DataFrame:
    """Adds a struct of NAMES; a column of docs named as into is replaced."""

    @F.pandas_udf(BASE)
    def run(texts: pd.Series) -> pd.DataFrame:
        let_go()
        return pd.DataFrame([counts(t) for t in texts], columns=NAMES, dtype="int64")

    return docs.withColumn(into, run.asNondeterministic()(F.col(text).cast("string")))


def rules() -> list[list[tuple[str, str, str]]]:
    """Families of (name, votes bad, votes good); a rule for which neither holds abstains. Expressions over NAMES. No threshold follows from the data."""
    return [
        [("symbols", "n_symbols > 0.1 * n_words", "n_symbols < 0.02 * n_words"), ("letters", "n_clean < 0.8 * n_words", "n_clean >= 0.95 * n_words")],
        [("capitals", "n_caps > 0.3 * n_words", "n_caps < 0.05 * n_words"), ("shouting", "n_shout > 0.1 * n_words", "n_shout < 0.01 * n_words")],
        [("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words < 0.1 * n_words"), ("vocabulary", "n_distinct < 0.4 * n_words", "n_distinct >= 0.55 * n_words"),
         ("dup_lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.05 * n_lines")],
        [("top_word", "n_top > 0.25 * n_words", "n_top < 0.15 * n_words"), ("compression", "n_packed < 0.35 * n_bytes", "n_packed between 0.42 * n_bytes and 0.75 * n_bytes")],
        [("short_words", "n_short < 0.15 * n_words or n_short > 0.6 * n_words", "n_short between 0.2 * n_words and 0.5 * n_words"),
         ("sentences", "n_closed < 0.02 * n_words or n_closed > 0.35 * n_words", "n_closed between 0.04 * n_words and 0.2 * n_words")],
        [("length", "n_words < 20", "n_words >= 100"), ("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars between 4 * n_words and 8 * n_words")],
    ]


def sizes() -> list[int]:
    return [len(f) for f in rules()]


def with_votes(measured: DataFrame) -> DataFrame:
    """pattern: the rules' votes, family by family, as digits of a number of base 3 (0 bad, 1 abstains, 2 good)."""
    code = F.lit(0)
    for family in rules():
        for _, bad, good in family:
            code = code * 3 + F.expr(f"case when {bad} then 0 when {good} then 2 else 1 end")
    return measured.withColumn("pattern", code.cast("int"))


def fit(weights: dict[int, int], families: list[int], rounds: int = 500, tol: float = 1e-9) -> tuple[dict[int, float], list[np.ndarray], float]:
    """EM over weighted vote patterns. Returns P(good) by pattern, P(joint vote | class) of each family as [class, joint vote], and the share of good texts.

    It starts from the share of good votes, so that class 1 is the one that the rules mostly call good.
    """
    codes = np.array(sorted(weights), np.int64)
    w = np.array([weights[k] for k in codes.tolist()], float)
    joint, rest = [], codes
    for n in reversed(families):
        joint.insert(0, rest % 3**n)
        rest = rest // 3**n
    digits = np.array([(codes // 3**k) % 3 for k in range(sum(families))]).reshape(sum(families), -1)
    post = (1 + (digits == 2).sum(0)) / (2 + (digits != 1).sum(0))
    tables, share = [np.full((2, 3**n), 3.0**-n) for n in families], PRIOR[0] / sum(PRIOR)
    for _ in range(rounds):
        share = ((w * post).sum() + PRIOR[0]) / (w.sum() + sum(PRIOR))
        log = np.full(len(codes), np.log(share / (1 - share)))
        for f, (j, n) in enumerate(zip(joint, families, strict=True)):
            t = np.stack([np.bincount(j, w * (1 - post), 3**n), np.bincount(j, w * post, 3**n)]) + PSEUDO
            tables[f] = t / t.sum(1, keepdims=True)
            log += np.log(tables[f][1, j] / tables[f][0, j])
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        moved = np.abs(new - post).max(initial=0.0)
        post = new
        if moved < tol:
            break
    return dict(zip(codes.tolist(), post.tolist(), strict=True)), tables, float(share)


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and posterior."""
    spark = docs.sparkSession
    base = stage(with_votes(measure(docs.select("doc_id", "text")).select("doc_id", "_base.*")), "quality-rules")
    weights = {r[0]: r[1] for r in base.groupBy("pattern").count().collect()}
    post, _, _ = fit(weights, sizes())
    table = spark.createDataFrame(list(post.items()), "pattern int, posterior double")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return base.join(F.broadcast(table), "pattern").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= threshold)).alias("kept"), F.col("posterior"))
