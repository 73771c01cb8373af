"""Chat formatting (operator 2): typed content parts are flattened by a visitor into text with ordered placeholders; turns become one training string with a loss mask.

Template: <|turn|>ROLE\\nTEXT<|end|>\\n for each turn. "<|" opens a control string; within roles and texts a backslash makes the next character
literal, and it is put before every backslash, before "<" of "<|", and before a newline in a role. So what was written can be read back exactly.
A conversation is one output row; its turns are sorted by (turn, role, text), nulls first, and null role or text counts as empty. Repeated rows are
turns of their own, a null conv_id is a conversation of its own, an empty table gives no rows. conv_id may have any type with an order; a turn that isn't a number counts as null.
Typed content: what isn't a JSON list of parts is a text as it stands. A part may be a text, null (empty) or an object; any other, and an object of no known type, is kept as its JSON text.
A size that isn't a finite number counts as 0, and each attachment stands for one token at least. Columns that aren't named are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TURN, END, OPEN = "<|turn|>", "<|end|>\n", "<|"
UNESCAPE = re.compile(r"\\(.)", re.S)
MARK = re.compile(r"\\.|<\|turn\|>|<\|end\|>\n|<\|(image|audio|document):(\d+)\|>", re.S)
#: What fits the column of token counts.
MAX_TOKENS = (1 << 62) - 1
OUT = "formatted string, loss array<struct<start:bigint,end:bigint>>, n_tokens_attached bigint, attachments array<struct<kind:string,ref:string,turn:int,start:bigint,tokens:bigint>>"


def number(x) -> float:
    """0 for what isn't a finite number; numbers may be written as texts."""
    try:
        x = float(x)
    except (TypeError, ValueError, OverflowError):
        return 0.0
    return x if math.isfinite(x) else 0.0


def parts_of(text: str | None) -> list:
    """The parts of a typed content column."""
    try:
        parts = json.loads(text) if text else [None]
    except (ValueError, RecursionError):
        return [text]
    return parts if isinstance(parts, list) else [text]


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace(OPEN, "\\" + OPEN)
    return out.replace("\n", "\\\n") if role else out


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


class Visitor:
    """visit(part) appends a part's text or placeholder; attachments are kept in order with the tokens that each placeholder stands for."""

    def __init__(self, tile: int = 512, tokens_per_tile: int = 256, audio_rate: int = 25, page_tokens: int = 512):
        self.tile, self.tokens_per_tile, self.audio_rate, self.page_tokens = tile, tokens_per_tile, audio_rate, page_tokens
        self.out: list[str] = []
        self.size = 0
        self.turn = 0
        self.found: list[dict] = []

    def put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit(self, part) -> None:
        if isinstance(part, str) or part is None:
            part = {"type": "text", "text": part}
        kind = part.get("type") if isinstance(part, dict) else None
        {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(kind if isinstance(kind, str) else "", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        self.put(escape("" if text is None else text if isinstance(text, str) else json.dumps(text, sort_keys=True, ensure_ascii=False)))

    def visit_image(self, part: dict) -> None:
        tiles = lambda x: max(1, -int(-number(x) // self.tile))
        self.attach("image", part, tiles(part.get("width")) * tiles(part.get("height")) * self.tokens_per_tile)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, -int(-number(part.get("seconds")) * self.audio_rate // 1)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, int(number(part.get("pages")))) * self.page_tokens)

    def visit_other(self, part) -> None:
        """A part of no known type is kept as its JSON text."""
        self.put(escape(json.dumps(part, sort_keys=True, ensure_ascii=False)))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        ref = part.get("ref")
        ref = ref if ref is None or isinstance(ref, str) else json.dumps(ref, sort_keys=True, ensure_ascii=False)
        self.found.append({"kind": kind, "ref": ref, "turn": self.turn, "start": self.size, "tokens": min(tokens, MAX_TOKENS)})
        self.put(f"<|{kind}:{len(self.found) - 1}|>")


class Formatter(Visitor):
    """A whole conversation; loss: spans of assistant texts in the formatted string."""

    def __init__(self, **sizes: int):
        super().__init__(**sizes)
        self.loss: list[dict] = []

    def add(self, role: str | None, content) -> None:
        self.put(f"{TURN}{escape(role or '', role=True)}\n")
        start = self.size
        for part in content if isinstance(content, list) else [content]:
            self.visit(part)
        if role == "assistant":
            self.loss.append({"start": start, "end": self.size})
        self.put(END)
        self.turn += 1

    @property
    def text(self) -> str:
        return "".join(self.out)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; placeholders stay in the text."""
    turns, at, head = [], 0, None
    for m in MARK.finditer(formatted):
        if m[0] == TURN:
            head = m.end()
        elif m[0] == END:
            raw = formatted[head : m.start()]
            cut = next(x.start() for x in re.finditer(r"\\.|\n", raw, re.S) if x[0] == "\n")
            turns.append((unescape(raw[:cut]), unescape(raw[cut + 1 :])))
            at = m.end()
    if at != len(formatted):
        raise ValueError("text outside of turns")
    return turns


def format_conversations(turns: DataFrame, content: str = "text", **sizes: int) -> DataFrame:
    """One row a conversation (conv_id and OUT). content: a string column, or with a name that ends in _json one whose text is a JSON list of typed parts.

    Turns are dealt by conversation and sorted within tasks (Spark spills), then read as a stream: a task keeps the one conversation it is writing.
    """
    parts = content.endswith("_json")
    rows = turns.select("conv_id", F.col("turn").try_cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col(content).cast("string").alias("content"))
    dealt = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "content")
    fields = [("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_tokens_attached", pa.int64()),
              ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("turn", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, done, size, schema = None, None, [], 0, None

        def row():
            return {"conv_id": now, "formatted": f.text, "loss": f.loss, "n_tokens_attached": min(sum(a["tokens"] for a in f.found), MAX_TOKENS), "attachments": f.found}

        for b in batches:
            schema = schema or pa.schema([("conv_id", b.schema.field("conv_id").type), *fields])
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "content")), strict=True):
                if f is None or c != now:
                    if f is not None:
                        done.append(row())
                        size += f.size
                    now, f = c, Formatter(**sizes)
                f.add(role, parts_of(text) if parts else text)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, size = [], 0
        if f is not None:
            done.append(row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return dealt.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {OUT}")


def digests(formatted: DataFrame) -> DataFrame:
    """Turn and loss digests, read back from the formatted strings alone."""
    import hashlib

    @F.pandas_udf("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    def back(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, ss in zip(texts, spans, strict=True):
            turns = read_back(t)
            loss = "".join(unescape(t[s["start"] : s["end"]]) for s in ss)
            sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(t)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.withColumn("_b", back.asNondeterministic()("formatted", "loss")).select("conv_id", "_b.*", F.size("loss").cast("bigint").alias("n_loss_spans"))
