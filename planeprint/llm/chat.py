"""Chat formatting with typed content parts.

A message has a role and a list of parts: text, image, audio or document. A visitor flattens the parts in order: text
is escaped, any other part becomes a placeholder, an attachment reference (kind, uri, place in the message) and a count
of the tokens that the placeholder stands for. Each turn is one segment of the conversation:

    <s>role, newline, content</s>newline

Control strings within texts and roles get a backslash and a dot after their first character, and backslashes are
doubled, so that no text can end a turn or forge a placeholder and reading back gives the very text. Segments are made
where their rows are; conversations are streamed in order of their turns, one segment at a time, so a conversation of any
length needs the memory of one turn.

Null text is empty, null role is the empty role, null parts are none. Turns that repeat a number are put in order of role
and text; a null conversation id is a conversation of its own. Unknown types of parts are an error of that row's part
alone: they become a document placeholder. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<s>", "</s>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that mean something to templates, this one or others; texts never hold them unescaped.
CONTROLS = (OPEN, CLOSE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", *PLACEHOLDERS.values())
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPE = re.compile(r"\\(\\|\.|n)")

PART = "struct<type:string,text:string,uri:string,width:long,height:long,seconds:double,pages:long>"
MESSAGE = f"conv_id long, turn long, role string, content array<{PART}>"
SEGMENT = "conv_id long, turn long, role string, segment string, loss_start long, loss_chars long, attachments array<struct<kind:string,uri:string,at:long,tokens:long>>, expanded_tokens long"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\." + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: {"\\": "\\", ".": "", "n": "\n"}[m[1]], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


@dataclass
class Flattener:
    """Visits the parts of one message; tokens of an image are 16-pixel-square patches in 2 by 2, of audio 25 a second,
    of a document 512 a page."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0
    tokens: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_document)(part)

    def _write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    def visit_text(self, part: dict) -> None:
        self._write(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "uri": part.get("uri"), "at": self.length, "tokens": tokens})
        self.tokens += tokens
        self._write(PLACEHOLDERS[kind])

    def visit_image(self, part: dict) -> None:
        side = lambda x: max(1, -(-(x or 0) // 32))
        self._attach("image", part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, -int(-25 * (part.get("seconds") or 0.0) // 1)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, 512 * max(1, part.get("pages") or 1))


def segment_of(role: str | None, content) -> tuple[str, int, int, list[dict], int]:
    """(segment, where its content starts, its length, attachments with places in the segment, expanded tokens)."""
    role = role or ""
    head = OPEN + escape_role(role) + "\n"
    f = Flattener()
    for part in content or []:
        if part is not None:
            f.visit(part)
    for a in f.attachments:
        a["at"] += len(head)
    return head + "".join(f.pieces) + CLOSE + "\n", len(head), f.length, f.attachments, f.tokens


def read_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a segment; placeholders stay as they are."""
    head, body = segment[len(OPEN) : -len(CLOSE) - 1].split("\n", 1)
    return unescape(head), unescape(body)


def format_messages(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, content) as segments, a row each. Assistants' contents are the loss mask:
    loss_start and loss_chars are places in the segment, 0 characters for other roles."""

    def run(batches):
        for batch in batches:
            ids, turns, roles, contents = (batch.column(i) for i in range(4))
            made = [segment_of(r, c) for r, c in zip(roles.to_pylist(), contents.to_pylist())]
            loss = [m[2] if r == "assistant" else 0 for m, r in zip(made, roles.to_pylist())]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
            arrays = [ids, turns, roles, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array(loss, pa.int64()), pa.array([m[3] for m in made], kind), pa.array([m[4] for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "role", "segment", "loss_start", "loss_chars", "attachments", "expanded_tokens"])

    return messages.select("conv_id", "turn", "role", "content").mapInArrow(common.lean(run), SEGMENT)


def text_messages(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) as messages of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "long"), ("height", "long"), ("seconds", "double"), ("pages", "long"))))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.array(part).alias("content"))


def digest(segments: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its segments in order: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, expanded_tokens."""
    spark = common.spark_of(segments)
    common.prepare(spark)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens"]

    def run(batches):
        state = None

        def ended():
            conv, n, turns, chars, loss, formatted, tokens = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, tokens)

        def packed(rows):
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            rows = []
            for conv, segment, start, chars, tokens in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append(ended())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = read_segment(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if chars:
                    masked = unescape(segment[start : start + chars])
                    state[3] += len(masked)
                    state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(segment)
                state[6] += tokens
            if rows:
                yield packed(rows)
        if state is not None:
            yield packed([ended()])

    body = F.expr(f"substring(segment, int(loss_start) + 1, char_length(segment) - int(loss_start) - {len(CLOSE) + 1})")
    text = F.regexp_replace(body, r"\\(?:(\\)|\.)", "$1")  # unescaped: turns that repeat a number and a role go by their texts
    ordered = segments.withColumns({"__role": F.coalesce("role", F.lit("")), "__text": text})
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "__role", "__text")
    ordered = ordered.select("conv_id", "segment", "loss_start", "loss_chars", "expanded_tokens")
    return ordered.mapInArrow(common.lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long")
