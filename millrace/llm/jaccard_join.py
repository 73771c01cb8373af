"""N-gram Jaccard join (operator 5): a grouped prefix join, exact.

A document's set is its distinct word shingles, as 64-bit hashes; without words it is empty and links with nothing. Documents with equal sets are one set, told by a
fingerprint of 128 bits: 64 of them are the set's key, and keys that two different sets share (CLASH) are replaced by the other half.

One global order of the tokens. Tokens that summaries over all rows call frequent come last, by hash. The others are halved by their hash; within a half the rarer come first, counted
exactly by Spark's own exchange. A set sends the first half only, unless its prefix is longer: which halves a set needs follows from the set alone, and a token's count is
taken over the sets that sent it, so the order is the same for all. Two sets with Jaccard >= percent / 100 share a token of their prefixes. A token that one set alone has sent pairs
nobody, but counts for the places of the others.

Sets with identical prefixes and size are one group. Groups that share a prefix token are paired, pairs are filtered by size and by the token's places, and only what is left is expanded to
members, which are verified on the whole sets. links() gives all pairs of different sets that link. join() asks for connectivity: first each list's most typical group
is verified against the others, and each group's most typical member against the others; then, only in lists that still hold more than one component, groups of
different components are paired. No list, group or candidate is cut, so no link that joins two components is lost.

Everything grows linearly but for the pairs that have to be verified. What is broadcast: the HOT_MAX most frequent tokens at most, and of heavy keys (common.spread_join) one row each. Null and empty
texts, repeated rows, repeated and null ids, empty tables: each row gets a result, and a row without words is its own component. doc_id may have any type with an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import kept, let_go, spread_join, stage, unstage
from .components import connected

SUMMARY, HOT_MIN, HOT_MAX, CHUNK = 40_000, 50, 500_000, 1 << 20
#: Of keys whose value is a whole set, so many are broadcast at most.
HEAVY_SETS = 100
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
# Odd multipliers: of the word hash, and of a shingle's words.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64. Those that a longer text than usual needs aren't kept."""
    make = lambda size: [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (np.uint64(BASE), np.uint64(INVERSE))]
    return kept("powers", lambda: make(CHUNK + 1024)) if n <= CHUNK + 1024 else make(n)


def chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Texts in lists of about CHUNK bytes; a longer one is alone in its list."""
    out, size = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if out and size + len(raw) > CHUNK:
            yield out
            out, size = [], 0
        out.append(raw)
        size += len(raw) + 1
    if out:
        yield out


def spelled(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and polynomial value of each run of bytes that aren't spaces, and which bytes are spaces."""
    up, down = powers(len(raw))
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([[np.uint64(0)], np.cumsum((LOWER[raw] + np.uint64(1)) * up[: len(raw)])])
    return start, end, (total[end] - total[start]) * down[np.minimum(start, len(raw) - 1)], space


def finished(value: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(value + length.astype(np.uint64) * MIX2)


def long_words(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, in blocks: a word that goes on in the next block is carried over."""
    out, value, length = [], 0, 0
    for k in range(0, len(raw), CHUNK):
        block = np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - k), k)
        start, end, values, space = spelled(block)
        lengths, last = end - start, 0 if len(space) and space[-1] else 1
        if length and len(start) and start[0] == 0:
            value, length = (value + int(values[0]) * pow(BASE, length, 1 << 64)) & (1 << 64) - 1, length + int(lengths[0])
            values, lengths = values[1:], lengths[1:]
            if last and not len(values):
                continue  # the word goes on
        if length:
            out.append(finished(np.array([value], np.uint64), np.array([length])))
            length = 0
        if last and len(values):
            value, length, values, lengths = int(values[-1]), int(lengths[-1]), values[:-1], lengths[:-1]
        out.append(finished(values, lengths))
    if length:
        out.append(finished(np.array([value], np.uint64), np.array([length])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    for part in chunks(texts):
        if len(part) == 1 and len(part[0]) > CHUNK:
            word = long_words(part[0])
            first_word, after_word = np.zeros(1, np.int64), np.array([len(word)])
        else:
            start, end, values, _ = spelled(np.frombuffer(b" ".join(part) + b" ", np.uint8))
            word = finished(values, end - start)
            size = np.array([len(x) for x in part], np.int64) + 1
            last = np.cumsum(size)
            first_word, after_word = np.searchsorted(start, last - size), np.searchsorted(start, last)
        m = len(word) - n + 1
        code = np.zeros(max(m, 0), np.uint64)
        for k in range(n):
            code = mix(code * MIX1 + word[k : k + m] + np.uint64(k + 1)) if m > 0 else code
        for a, b in zip(first_word.tolist(), after_word.tolist(), strict=True):
            if b - a >= n:
                s = np.sort(code[a : b - n + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                h = np.array([b - a], np.uint64)
                for k in range(a, b):
                    h = mix(h * MIX1 + word[k : k + 1] + np.uint64(77))
                yield h
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray, seed: int = 0) -> int:
    """Of a set of hashes, whatever their order."""
    h = int(mix(s + np.uint64(seed + 0x51ED27)).sum(dtype=np.uint64)) + len(s) * 0x2545F4914F6CDD1D & (1 << 64) - 1
    return int(mix(np.array([h], np.uint64)).view(np.int64)[0])


class Summary:
    """Frequent tokens of a stream in bounded memory: when too many are kept, the count of the first that doesn't fit is taken from all (Misra and Gries)."""

    def __init__(self, keep: int = SUMMARY):
        self.keep = keep
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        tokens.sort()
        at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
        new, n = tokens[at], np.diff(np.append(at, len(tokens)))
        both, place = np.unique(np.concatenate([self.tokens, new]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([self.counts, n]), len(both)).astype(np.int64)
        if len(both) > self.keep:
            counts -= np.partition(counts, len(both) - self.keep - 1)[len(both) - self.keep - 1]
            both, counts = both[counts > 0], counts[counts > 0]
        self.tokens, self.counts = both, counts


def key_of(s: np.ndarray, mask: int, clash: frozenset[int]) -> int:
    """The set's key: half of its fingerprint, or the other half where two sets share the first."""
    k = fingerprint(s) & mask
    return fingerprint(s, 1) if k in clash else k


def measured(docs: DataFrame, n: int, mask: int) -> DataFrame:
    """Rows (doc_id, fp, other, n, text_hash) of documents, and (token, count) of the tasks' summaries of frequent tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        summary, schema = Summary(), None
        for b in batches:
            schema = schema or pa.schema([("doc_id", b.schema.field("doc_id").type), ("text_hash", pa.int64()), ("fp", pa.int64()), ("other", pa.int64()), ("n", pa.int32()), ("token", pa.int64()), ("count", pa.int64())])
            fps, others, ns, seen = [], [], [], {}
            for s in sets(b.column("text").to_pylist(), n):
                fps.append(fingerprint(s) & mask if len(s) else None)
                others.append(fingerprint(s, 1) if len(s) else None)
                ns.append(len(s))
                if len(s):
                    seen[others[-1]] = s
            if seen:
                summary.add(np.concatenate(list(seen.values())))
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fps, pa.int64()), pa.array(others, pa.int64()), pa.array(ns, pa.int32()), none, none], schema=schema)
        hot = summary.counts > 2
        if hot.any():
            m = int(hot.sum())
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(m, schema.field("doc_id").type), none, none, none, pa.nulls(m, pa.int32()), pa.array(summary.tokens[hot].view(np.int64)), pa.array(summary.counts[hot])], schema=schema)

    rows = docs.select("doc_id", text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint, other bigint, n int, token bigint, count bigint")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def sent_tokens(docs: DataFrame, n: int, percent: int, mask: int, clash: frozenset[int], hot) -> DataFrame:
    """Rows (tok, fp, a, b) of each batch's different sets, in three kinds.

    b null: tok is a token that isn't frequent, of the first half, or of both if the prefix reaches into the second. b >= 0: about the set, tok is its own;
    a holds its size and, in the low 32 bits, its tokens in the first half, b those sent of the second. b < 0: a is a frequent token that belongs to the prefix, -b - 1 its place, tok is of no meaning.
    """
    schema = pa.schema([("tok", pa.int64()), ("fp", pa.int64()), ("a", pa.int64()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        common = np.frombuffer(hot.value, np.uint64)
        for batch in batches:
            fps, all_sets = [], []
            seen: set[int] = set()
            for s in sets(batch.column("text").to_pylist(), n):
                if len(s) and (fp := key_of(s, mask, clash)) not in seen:
                    seen.add(fp)
                    fps.append(fp)
                    all_sets.append(s)
            if not fps:
                continue
            fp, size = np.array(fps, np.int64), np.array(list(map(len, all_sets)))
            tok, doc = np.concatenate(all_sets), np.repeat(np.arange(len(fp)), size)
            at = np.searchsorted(common, tok)
            often = common[np.minimum(at, len(common) - 1)] == tok if len(common) else np.zeros(len(tok), bool)
            second = (tok >> np.uint64(63)).astype(bool)
            need = prefix_length(size, percent)
            rare = np.bincount(doc[~often], minlength=len(fp))
            first = np.bincount(doc[~often & ~second], minlength=len(fp))
            reach = first < need
            late = np.flatnonzero(often)
            place = rare[doc[late]] + np.arange(len(late)) - np.searchsorted(doc[late], np.arange(len(fp)))[doc[late]]
            late, place = late[place < need[doc[late]]], place[place < need[doc[late]]]
            send = ~often & (~second | reach[doc])
            toks = np.concatenate([tok[send], mix(fp.view(np.uint64) + MIX2), mix(tok[late] ^ mix(fp[doc[late]].view(np.uint64)))])
            k, m = int(send.sum()), len(fp)
            a = np.concatenate([np.zeros(k, np.int64), size.astype(np.int64) << 32 | first, tok[late].view(np.int64)])
            b = np.concatenate([np.zeros(k, np.int32), np.where(reach, rare - first, 0).astype(np.int32), (-1 - place).astype(np.int32)])
            none = np.arange(len(a)) < k
            yield pa.RecordBatch.from_arrays([pa.array(toks.view(np.int64)), pa.array(np.concatenate([fp[doc[send]], fp, fp[doc[late]]])), pa.array(a, mask=none), pa.array(b, mask=none)], schema=schema)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "tok bigint, fp bigint, a bigint, b int")


def prefixes(sent: DataFrame, percent: int) -> DataFrame:
    """Rows (key, fp, g, n, place, u): token key is at that place of the set's order, within its prefix, and another set has sent it, too. g: the group. u: how many tokens the set alone has sent."""
    by_token = Window.partitionBy("tok")
    new = F.coalesce(F.lag("fp").over(by_token.orderBy("fp")) != F.col("fp"), F.lit(True))  # a set that several batches have counts once
    once = sent.withColumn("_new", new).withColumn("df", F.sum(F.col("_new").cast("int")).over(by_token)).where(F.col("_new") & (F.col("b").isNotNull() | (F.col("df") > 1)))
    by_set = Window.partitionBy("fp")
    token, second = F.col("b").isNull(), F.shiftrightunsigned("tok", 63) == 1
    about = F.max(F.when(F.col("b") >= 0, F.struct("a", "b"))).over(by_set)
    ranked = once.select(
        "tok", "fp", "a", "b", second.alias("second"), about.alias("about"),
        F.sum(F.when(token & ~second, 1).otherwise(0)).over(by_set).alias("many1"), F.sum(F.when(token & second, 1).otherwise(0)).over(by_set).alias("many2"),
        F.row_number().over(by_set.orderBy(F.when(token, second.cast("int")).otherwise(2), "df", "tok")).alias("rank"))
    n, first = F.shiftright("about.a", 32).cast("int"), F.col("about.a").bitwiseAND(0xFFFFFFFF).cast("int")
    alone1, alone2 = first - F.col("many1"), F.col("about.b") - F.col("many2")
    place = F.when(F.col("b") < 0, -1 - F.col("b")).when(F.col("second"), first + alone2 + F.col("rank") - 1 - F.col("many1")).otherwise(alone1 + F.col("rank") - 1)
    need = n - F.floor((n * percent + 99) / 100).cast("int") + 1
    alone_in_prefix = (alone1 > 0) | ((need > first) & (alone2 > 0))
    got = ranked.where("b is null or b < 0").select(F.when(F.col("b") < 0, F.col("a")).otherwise(F.col("tok")).alias("key"), "fp", n.alias("n"), place.cast("int").alias("place"),
                                                  (alone1 + alone2).cast("int").alias("u"), need.alias("need"), alone_in_prefix.alias("own")).where("place < need")
    x = lambda seed: F.bit_xor(F.xxhash64("key", F.lit(seed))).over(by_set)
    return got.select("key", "fp", F.when(F.col("own"), F.col("fp")).otherwise(F.xxhash64("n", x(1), x(2))).alias("g"), "n", "place", "u")


def whole_sets(docs: DataFrame, n: int, mask: int, clash: frozenset[int]) -> DataFrame:
    """fp and tokens (all hashes of the set), once for each batch."""
    schema = pa.schema([("fp", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            fps, got, size = [], [], 0
            done: set[int] = set()
            for s in sets(b.column("text").to_pylist(), n):
                if not len(s) or (fp := key_of(s, mask, clash)) in done:
                    continue
                done.add(fp)
                fps.append(fp)
                got.append(s.view(np.int64))
                size += len(s)
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(got, pa.list_(pa.int64()))], schema=schema)
                    fps, got, size = [], [], 0
            if fps:
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(got, pa.list_(pa.int64()))], schema=schema)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "fp bigint, tokens array<bigint>")


def may_link(percent: int, na: str, ma: str, nb: str, mb: str) -> Column:
    """Size and place filter: n is a set's size, m how many of its tokens are from the list's token on. If that is the first token that two sets share, no more than
    the lesser m can be common, and the rest of both is in the union; if it isn't, they meet in the list of the first, too."""
    common = F.least(ma, mb)
    return F.lit(100) * common >= F.lit(percent) * (F.col(na) + F.col(nb) - common)


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of the (staged) pairs (a, b) whose whole sets link."""
    a, b = tokens.select(F.col("fp").alias("a"), F.col("tokens").alias("ta")), tokens.select(F.col("fp").alias("b"), F.col("tokens").alias("tb"))
    left = spread_join(pairs, a, "a", heavy=HEAVY_SETS)
    both = left.join(b, "b").select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("i"), F.size("ta").alias("na"), F.size("tb").alias("nb"))
    return both.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


class Candidates:
    """The sets of docs and their lists. rows: (doc_id, fp, n) of each document. sets: (fp, least doc_id) of each different set. lists: (key, g, n, place, m, u) of each group in each list that
    more than one group is in. members: (g, fp, n, u) of groups in lists, or with more than one member. tokens: the whole sets of members."""

    def __init__(self, docs: DataFrame, n: int, percent: int, bits: int = 64):
        spark, mask = docs.sparkSession, -1 if bits == 64 else (1 << bits) - 1
        docs = docs.select("doc_id", "text")
        self.percent = percent
        seen = stage(measured(docs, n, mask), "jaccard-rows")
        frequent = seen.where("token is not null").groupBy("token").agg(F.sum("count").alias("c")).where(F.col("c") >= HOT_MIN).orderBy(F.col("c").desc(), "token").limit(HOT_MAX)
        hot = spark.sparkContext.broadcast(np.sort(np.array(frequent.select("token").toArrow().column("token").to_numpy(), np.int64).view(np.uint64)).tobytes())
        rows = seen.where("token is null").select("doc_id", "text_hash", "fp", "other", "n")
        self.staged = [seen]
        one = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.min(F.struct("other", "n")).alias("lo"), F.max(F.struct("other", "n")).alias("hi"))
        sets_ = stage(one.select("fp", "least", "text_hash", (F.col("lo") != F.col("hi")).alias("clash")), "jaccard-sets")
        clash = frozenset(r[0] for r in sets_.where("clash").select("fp").collect())  # of 10^10 sets about three
        if clash:
            unstage(sets_)
            rows = stage(rows.withColumn("fp", F.when(F.col("fp").isin(list(clash)), F.col("other")).otherwise(F.col("fp"))), "jaccard-rows")
            sets_ = stage(rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash")), "jaccard-sets")
            self.staged.append(rows)
        self.rows, self.sets = rows.select("doc_id", "fp", "n"), sets_
        held = stage(prefixes(sent_tokens(docs, n, percent, mask, clash, hot), percent), "jaccard-prefixes")
        self.members = stage(held.groupBy("g", "fp").agg(F.first("n").alias("n"), F.first("u").alias("u")), "jaccard-members")
        in_lists = held.groupBy("key", "g", "n", "place").agg(F.min("u").alias("u"))
        self.lists = stage(in_lists.withColumn("m", F.col("n") - F.col("place")), "jaccard-lists")
        unstage(held)
        texts = stage(self.sets.join(self.members.select("fp").distinct(), "fp", "left_semi").select("text_hash").distinct(), "jaccard-texts")
        whole = spread_join(docs.select("text", text_hash().alias("text_hash")), texts, "text_hash", "left_semi", by=seen.where("token is null").select("text_hash"))
        self.tokens = stage(whole_sets(whole, n, mask, clash).dropDuplicates(["fp"]), "jaccard-tokens")
        unstage(texts)
        self.staged += [sets_, self.members, self.lists, self.tokens]

    def reps(self) -> DataFrame:
        """Each group's most typical member."""
        return self.members.groupBy("g").agg(F.min(F.struct("u", "fp")).alias("r"), F.count(F.lit(1)).alias("c")).select("g", F.col("r.fp").alias("rep"), "c")

    def close(self) -> None:
        unstage(*self.staged)


def ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a != b")


def links(docs: DataFrame, n: int = 5, percent: int = 80, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """All links: (doc_id, set) of each row of docs with words, and (u, v, u < v) of all pairs of different sets that link. Rows of one set link with each other, too."""
    c = Candidates(docs, n, percent, bits)
    side = lambda x: c.lists.select("key", *(F.col(k).alias(f"{k}{x}") for k in ("g", "n", "m")))
    pairs = side("a").join(side("b"), "key").where((F.col("ga") < F.col("gb")) & may_link(percent, "na", "ma", "nb", "mb")).select("ga", "gb").distinct()
    of = lambda x: c.members.select(F.col("g").alias(f"g{x}"), F.col("fp").alias(x))
    across = ordered(pairs.join(of("a"), "ga").join(of("b"), "gb"), "a", "b")
    inside = ordered(c.members.select("g", F.col("fp").alias("a")).join(c.members.select("g", F.col("fp").alias("b")), "g").where("a < b"), "a", "b")
    tried = stage(across.unionByName(inside).distinct(), "jaccard-pairs")
    return c.rows.where("n > 0").select("doc_id", F.col("fp").alias("set")), verified(tried, c.tokens, percent)


def degrees(docs: DataFrame, n: int = 5, percent: int = 80, bits: int = 64) -> DataFrame:
    """doc_id and n_links: how many other rows each row with words links with, copies included. One result row per input row with words."""
    rows, pairs = links(docs, n, percent, bits)
    rows, pairs = stage(rows, "jaccard-rows"), stage(pairs, "jaccard-links")
    size = stage(rows.groupBy("set").agg(F.count(F.lit(1)).alias("copies")), "jaccard-sizes")
    both = pairs.select(F.col("u").alias("set"), F.col("v").alias("o")).unionByName(pairs.select(F.col("v").alias("set"), F.col("u").alias("o")))
    others = both.join(size.select(F.col("set").alias("o"), "copies"), "o").groupBy("set").agg(F.sum("copies").alias("others"))
    per = stage(size.join(others, "set", "left").select("set", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "jaccard-degrees")
    return spread_join(rows, per, "set").select("doc_id", "n_links")


def connectivity(c: Candidates) -> DataFrame:
    """(node, component) of the sets that link with others."""
    percent = c.percent
    reps = stage(c.reps(), "jaccard-reps")
    per = c.lists.groupBy("key").agg(F.min(F.struct("u", "g", "n", "m")).alias("p"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi").select("key", "p")
    typical = spread_join(c.lists, stage(per, "jaccard-pivots"), "key").select("g", "n", "m", F.col("p.g").alias("pg"), F.col("p.n").alias("pn"), F.col("p.m").alias("pm"))
    group_pairs = ordered(typical.where(may_link(percent, "n", "m", "pn", "pm")), "g", "pg").distinct()
    rep = lambda g, x: reps.select(F.col("g").alias(g), F.col("rep").alias(x))
    across = ordered(spread_join(stage(group_pairs, "jaccard-groups"), rep("a", "x"), "a").join(rep("b", "y"), "b"), "x", "y")
    inside = ordered(spread_join(c.members, reps.where("c > 1").select("g", "rep"), "g"), "fp", "rep")
    tried = stage(across.unionByName(inside).distinct(), "jaccard-pairs")
    first = stage(verified(tried, c.tokens, percent), "jaccard-links")
    parts = connected(first)

    at = stage(c.members.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "jaccard-at")
    # lists and groups that still hold several components; pairs of components first, then of groups, then of members: what is joined is what has to be verified, not the list's square
    places = spread_join(c.lists, stage(at.select("g", "component").distinct(), "jaccard-inside"), "g", many=True)
    open_keys = places.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    left = stage(places.join(open_keys, "key", "left_semi").select("key", "g", "n", "m", "component"), "jaccard-open")
    bounds = left.groupBy("key", "component").agg(F.min("n").alias("n"), F.max("m").alias("m"))
    side = lambda x: bounds.select("key", F.col("component").alias(f"c{x}"), F.col("n").alias(f"cn{x}"), F.col("m").alias(f"cm{x}"))
    two = side("a").join(side("b"), "key").where((F.col("ca") < F.col("cb")) & may_link(percent, "cna", "cma", "cnb", "cmb")).select("key", "ca", "cb", "cnb", "cmb")
    x = left.select("key", F.col("component").alias("ca"), F.col("g").alias("ga"), F.col("n").alias("na"), F.col("m").alias("ma"))
    y = left.select("key", F.col("component").alias("cb"), F.col("g").alias("gb"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    one = two.join(x, ["key", "ca"]).where(may_link(percent, "na", "ma", "cnb", "cmb"))
    groups = one.join(y, ["key", "cb"]).where(may_link(percent, "na", "ma", "nb", "mb")).select("ga", "ca", "gb", "cb").distinct()
    of = lambda k: at.select(F.col("g").alias(f"g{k}"), F.col("component").alias(f"c{k}"), F.col("fp").alias(k))
    apart = at.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("g")
    split = at.join(apart, "g", "left_semi").select("g", "component").distinct()
    within = split.select(F.col("g").alias("ga"), F.col("component").alias("ca")).join(split.select(F.col("g").alias("gb"), F.col("component").alias("cb")), (F.col("ga") == F.col("gb")) & (F.col("ca") < F.col("cb")))
    more = ordered(groups.unionByName(within).join(of("a"), ["ga", "ca"]).join(of("b"), ["gb", "cb"]), "a", "b").distinct()
    second = stage(verified(stage(more.join(tried, ["a", "b"], "left_anti"), "jaccard-more"), c.tokens, percent), "jaccard-links")
    return parts if second.isEmpty() else connected(first.unionByName(second))


def join(docs: DataFrame, n: int = 5, percent: int = 80, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links, itself included) for each row of docs. doc_id may be a struct, by which callers tell rows with repeated or null ids apart.
    bits: of the first half of the fingerprint, for tests."""
    c = Candidates(docs, n, percent, bits)
    parts = stage(connectivity(c).withColumnRenamed("node", "fp"), "jaccard-parts")
    own = stage(parts.join(c.sets.select("fp", "least"), "fp"), "jaccard-least")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = spread_join(own, stage(least, "jaccard-components"), "component").select("fp", "component_id")
    ids = stage(c.sets.select("fp", "least").join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "jaccard-ids")
    unstage(c.members, c.lists, c.tokens, parts, own)
    return spread_join(c.rows, ids, "fp", "left").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
