"""Byte-level BPE (operator 4) as a lazily determinised finite-state transducer, and a streaming decoder with an incremental UTF-8 state machine.

The merges are compiled into a nondeterministic transducer over bytes: a configuration is (last token, place in the trie of tokens, tokens not yet
written), and a token may follow another only if the merges keep the two apart. At each boundary one parse at most is alive, so the subset construction is
deterministic; its states are made when first met. A token is written as soon as all configurations agree on it, after at most as many bytes as the longest token has.

A state table or word memo that is full is dropped and built anew, which changes no result and bounds memory. Null and empty texts have no tokens; repeated rows get equal results, an empty table
gives no rows, and a column named like the result is replaced by it. In decoding, bytes that can't be UTF-8, and ids that no token has, become U+FFFD, and null ids are passed over.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from .common import kept, let_go, trim

MAX_STATES, MAX_WORDS, MAX_WORD = 120_000, 450_000, 64
START, ROOT, NEVER = -1, 0, 1 << 60


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merge(word: bytes, ranks: dict[bytes, int], below: int = NEVER) -> list[bytes]:
    """The merges themselves, lowest rank first, of ranks under a bound: used to compile."""
    parts = [word[k : k + 1] for k in range(len(word))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        self.child: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        self.left: dict[int, list[tuple[bytes, int]]] = {}
        self.right: dict[int, list[tuple[bytes, int]]] = {}
        for token, k in sorted(ranks.items(), key=lambda x: x[1]):
            self.bytes_of[k] = token
            parts = merge(token, ranks, k)
            if len(parts) > 2 or not all(ranks[p] in self.left for p in parts if len(token) > 1):  # no merges lead to it: it is written only as a whole word
                continue
            self.left[k], self.right[k] = self.edges(token, k, parts)
            node = ROOT
            for b in token:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token_at.append(-1)
                node = self.child[node][b]
            self.token_at[node] = k
        self.apart: dict[int, bool] = {}
        self.reset()

    def edges(self, token: bytes, k: int, parts: list[bytes]) -> tuple[list, list]:
        """The tokens that stand at a token's left and right edge while its merges run, each with the rank of the merge that ends it."""
        if len(parts) == 1:
            return [(token, NEVER)], [(token, NEVER)]
        first, last = self.ranks[parts[0]], self.ranks[parts[1]]
        end = lambda run: [*run[:-1], (run[-1][0], k), (token, NEVER)]
        return end(self.left[first]), end(self.right[last])

    def reset(self) -> None:
        first = ((START, ROOT, ()),)
        self.states: list[tuple] = [first]
        self.ids = {first: 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges keep the two apart: none joins what stands at the border while both sides stand there. Of equal ranks the left merge runs first."""
        key = a << 32 | b
        if (ok := self.apart.get(key)) is not None:
            return ok
        if len(self.apart) > 4 * self.max_states:
            self.apart.clear()
        left, right, ranks = self.right[a], self.left[b], self.ranks
        i = j = 0
        while True:
            (x, end_x), (y, end_y) = left[i], right[j]
            r = ranks.get(x + y)
            if r is not None and r < end_x and r <= end_y:
                ok = False
                break
            if end_x == end_y == NEVER:
                ok = True
                break
            if end_x <= end_y:
                i += 1
            else:
                j += 1
        self.apart[key] = ok
        return ok

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """Next subset of configurations, and the tokens that all of them agree on."""
        new, child, token_at, apart = [], self.child, self.token_at, self.apart
        for last, node, held in state:
            to = child[node].get(byte)
            if to is None:
                continue
            if child[to]:
                new.append((last, to, held))
            token = token_at[to]
            if token >= 0:
                if last == START:
                    new.append((token, ROOT, (token,)))
                    continue
                ok = apart.get(last << 32 | token)
                if ok or ok is None and self.may_follow(last, token):
                    new.append((token, ROOT, (*held, token)))
        if not new:
            raise ValueError("a byte that isn't a token itself")
        if len(new) == 1:
            last, node, held = new[0]
            return ((last, node, ()),), held
        head = new[0][2]
        n = 0
        for t in head:
            if any(len(c[2]) <= n or c[2][n] != t for c in new):
                break
            n += 1
        return (tuple((a, b, c[n:]) for a, b, c in new) if n else tuple(new)), head[:n]

    def feed(self, data: bytes, out: list[int]) -> tuple:
        """From the start over all of data; returns the state. A move gets its place in the table when it is met for the second time, as most words' last moves never are; in long words, which no memo keeps, at once."""
        moves, at, long = self.moves, 0, len(data) > MAX_WORD
        for k, byte in enumerate(data):
            move = moves[at].get(byte, 0)
            if not move:
                state, emitted = self.step(self.states[at], byte)
                if move is None or long and len(self.states) <= self.max_states:
                    to = self.ids.get(state)
                    if to is None:
                        to = self.ids[state] = len(self.states)
                        self.states.append(state)
                        moves.append({})
                    move = moves[at][byte] = (to, emitted)
                else:
                    moves[at][byte] = None
                    out.extend(emitted)
                    for rest in data[k + 1 :]:
                        state, emitted = self.step(state, rest)
                        out.extend(emitted)
                    return state
            at, emitted = move
            if emitted:
                out.extend(emitted)
        return self.states[at]

    def last(self, state: tuple, byte: int) -> tuple[int, ...]:
        """What is still to be written if the word ends with this byte: the held tokens of the one parse that ends there."""
        for last, node, held in state:
            to = self.child[node].get(byte)
            if to is not None and (token := self.token_at[to]) >= 0 and (last == START or self.may_follow(last, token)):
                return (*held, token)
        raise ValueError("a byte that isn't a token itself")

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one word. A state table that is full is dropped before the word."""
        whole = self.ranks.get(word)
        if whole is not None or not word:
            return [whole] if word else []
        if len(self.states) > self.max_states:
            self.reset()
        out: list[int] = []
        state = self.feed(word[:-1], out)
        out.extend(self.last(state, word[-1]))
        return out


class Words(dict):
    """Memo of the transducer's results for short words, in two generations: when the young one is full it becomes the old one, and what is still met moves back."""

    def __init__(self, machine: Transducer, most: int = MAX_WORDS):
        super().__init__()
        self.machine, self.most, self.old = machine, most, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = self.old.get(word)
        if out is None:
            out = tuple(self.machine.encode(word.encode("utf-8", "surrogatepass")))
        if len(word) <= MAX_WORD:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


def latin_pattern(pattern: str) -> str:
    """The same pattern with its classes spelled out for code points below 256, for the faster engine of re."""
    members = lambda c: "".join(re.escape(chr(k)) for k in range(256) if regex.match(c, chr(k)))
    letters, numbers, spaces = (members(c) for c in (r"\p{L}", r"\p{N}", r"\s"))
    inside = lambda m: m[0].replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", spaces)
    out = re.sub(r"\[[^\]]*\]", inside, pattern)
    for c, k in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", spaces)):
        out = out.replace(c, f"[{k}]")
    return out.replace(r"\S", f"[^{spaces}]")


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, states: int = MAX_STATES, words: int = MAX_WORDS):
        self.machine = Transducer(ranks, states)
        self.words = Words(self.machine, words)
        self.split = regex.compile(pattern).findall
        self.split_latin = re.compile(latin_pattern(pattern)).findall

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split(text)
        return self.split_latin(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.pieces(text)))) if text else []


class Utf8Machine:
    """Incremental UTF-8: bytes still wanted, the bounds of the next one, and the value so far. What can't be UTF-8 becomes U+FFFD."""

    def __init__(self):
        self.want, self.low, self.high, self.value = 0, 0x80, 0xBF, 0

    def push(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.want:
                if self.low <= b <= self.high:
                    self.want -= 1
                    self.value = self.value << 6 | b & 0x3F
                    self.low, self.high = 0x80, 0xBF
                    if not self.want:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.want, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.want = 1 + (b >= 0xE0) + (b >= 0xF0)
                self.value = b & (0x3F >> self.want)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.want, self.low, self.high = self.want, 0, 0x80, 0xBF
        return "�" if left else ""


class StreamDecoder:
    """push(ids) gives the text that is certain so far; end() the rest."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of
        self.machine = Utf8Machine()
        self.text_of: list[str | None] = []
        for raw in bytes_of:
            m = Utf8Machine()
            text = m.push(raw)
            self.text_of.append(text if not m.want and "�" not in text else None)

    def push(self, ids: Iterable[int | None]) -> str:
        out, m, n = [], self.machine, len(self.text_of)
        for k in ids:
            if k is None:
                continue
            if not 0 <= k < n or not self.bytes_of[k]:
                out.append(m.end() + "\ufffd")
                continue
            t = self.text_of[k]
            out.append(t if t is not None and not m.want else m.push(self.bytes_of[k]))
        return "".join(out)

    def end(self) -> str:
        return self.machine.end()

    def fresh(self) -> StreamDecoder:
        """Another one of the same tables, at its start."""
        out = object.__new__(StreamDecoder)
        out.bytes_of, out.text_of, out.machine = self.bytes_of, self.text_of, Utf8Machine()
        return out

    def whole(self, ids: list[int]) -> str:
        """All of a text at once, from ids that the encoder has made."""
        try:
            return "".join(map(self.text_of.__getitem__, ids))  # no token leaves the machine within a character
        except TypeError:
            return self.push(ids) + self.end()


def compiled(raw: bytes, pattern: str, states: int = MAX_STATES, words: int = MAX_WORDS) -> tuple[Encoder, StreamDecoder, list[str]]:
    e = Encoder(load_ranks(raw), pattern, states, words)
    return e, StreamDecoder(e.machine.bytes_of), [str(k) for k in range(len(e.machine.bytes_of))]


def machines(raw: bytes, pattern: str, states: int = MAX_STATES, words: int = MAX_WORDS) -> tuple[Encoder, StreamDecoder, list[str]]:
    """Compiled once a Python worker, kept until it serves another operator."""
    return kept((hashlib.sha256(raw).hexdigest(), pattern, states, words), lambda: compiled(raw, pattern, states, words))


def encode(docs: DataFrame, ranks: bytes, pattern: str, into: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text. ranks: the rank file's bytes (under 1 MB), broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        e = machines(held.value, pattern)[0]
        return pd.Series([e.encode(t) for t in texts], dtype=object)

    return docs.withColumn(into, run.asNondeterministic()(F.col("text").cast("string")))


def decode(rows: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Adds the text of a column of token ids, by the incremental machine; null ids give a null text."""
    held = rows.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        make = machines(held.value, pattern)[1]
        out = []
        for x in lists:
            d = make.fresh()
            out.append(None if x is None else d.push(None if k is None or k != k else int(k) for k in x) + d.end())
        return pd.Series(out, dtype=object)

    return rows.withColumn(into, run.asNondeterministic()(F.col(ids).cast("array<bigint>")))


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, into: str = "bpe", with_ids: bool = False, keep: bool = True, states: int = MAX_STATES, words: int = MAX_WORDS) -> DataFrame:
    """Adds a struct (n_tokens, ids_sha256, decoded_sha256, and ids if asked for) of each whole text: encoded, then decoded again from the ids alone.
    keep: whether a Python worker keeps its tables (of at most so many states and words) from task to task; without it tasks cost more time, and workers that wait hold no memory."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not keep:
            let_go()
        e, d, names = (machines if keep else compiled)(held.value, pattern, states, words)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for texts in batches:
            rows = []
            gc.disable()  # the tables hold no cycles, and passing over them costs more than all else
            try:
                for t in texts:
                    ids = e.encode(t)
                    rows.append((len(ids), sha(",".join(map(names.__getitem__, ids)).encode()), sha(d.whole(ids).encode("utf-8", "surrogatepass")), *[ids] * with_ids))
            finally:
                gc.enable()
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
        if not keep:
            del e, d, names
            trim()

    return docs.withColumn(into, run.asNondeterministic()(F.col("text").cast("string")))
