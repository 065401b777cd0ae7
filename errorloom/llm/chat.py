"""Formatting conversations whose turns hold typed content parts.

A visitor goes through the parts of a turn in order. Text is escaped and copied; an image, a sound or a
document leaves a placeholder and an attachment record: kind, reference, where the placeholder stands, and
how many tokens it expands to. Turns are formatted one by one, without a shuffle, so no conversation is ever
held as a whole; ``read_back`` streams over them in order.

The template marks a turn as ``<|turn|>role``, a line end, the content, ``<|end|>`` and a line end. Control
strings inside texts, of this template and of other common ones, get a backslash after their first
character, or one more if some are there already, which unescaping takes away again.
"""

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
# What follows the first character of the strings to escape: <| of any marker, and other templates' marks.
CONTROL = r"\||/?s>|/?INST\]|/?SYS>|<SYS>|</SYS>"
ESCAPE = re.compile(rf"([<\[])(\\*)({CONTROL})")
UNESCAPE = re.compile(rf"([<\[])(\\*)\\({CONTROL})")

PATCH = 14  # pixels along the side of an image patch that becomes a token
SOUND_RATE = 25  # tokens a second
PAGE_TOKENS = 512

PARTS = "array<struct<kind string, text string, ref string, width int, height int, seconds double, pages int>>"
FORMATTED = (
    "conv_id bigint, turn bigint, role string, formatted string, loss_start int, loss_end int, "
    "attachments array<struct<kind string, ref string, position int, tokens bigint>>"
)


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


class Visitor:
    """Flattens the parts of one turn."""

    def __init__(self, start: int):
        self.out, self.position, self.attachments = [], start, []

    def visit(self, part) -> None:
        getattr(self, part["kind"] or "text", self.other)(part)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.position += len(text)

    def attach(self, part, tokens: int) -> None:
        self.attachments.append((part["kind"], part["ref"], self.position, max(0, tokens)))
        self.write(f"<|{part['kind']}|>")

    def text(self, part) -> None:
        self.write(escape(part["text"] or ""))

    def image(self, part) -> None:
        self.attach(part, math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH))

    def audio(self, part) -> None:
        self.attach(part, math.ceil((part["seconds"] or 0) * SOUND_RATE))

    def document(self, part) -> None:
        self.attach(part, (part["pages"] or 0) * PAGE_TOKENS)

    def other(self, part) -> None:
        raise ValueError(f"a content part can't be of kind {part['kind']!r}")


def text_parts(text: Column) -> Column:
    """A text as the only part of its turn."""
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"),
                            *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()]))


def format_turn(role: str, parts) -> tuple:
    """(formatted, start and end of the loss, attachments). Only what an assistant says bears loss."""
    head = f"{TURN}{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"
    visitor = Visitor(len(head))
    for part in parts:
        if part is not None:
            visitor.visit(part)
    end = visitor.position
    start = len(head) if role == "assistant" else end
    return head + "".join(visitor.out) + f"{END}\n", start, end, visitor.attachments


def format_turns(turns: DataFrame, parts: Column) -> DataFrame:
    """One row per turn: ``FORMATTED``. Loss and attachments are places in ``formatted``, by code points.

    Null texts, roles and parts count as empty; null ids and turns stay null. Unknown kinds of parts are an
    error. Columns beyond conv_id, turn and role are not read. Repeated rows are formatted each.
    """

    def formatted(frames):
        for frame in frames:
            rows = []
            for conv, turn, role, content in zip(frame["conv_id"], frame["turn"], frame["role"], frame["parts"]):
                text, start, end, attachments = format_turn(role or "", content if content is not None else ())
                rows.append((conv, turn, role, text, start, end, attachments))
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments"])
            yield out.astype({"conv_id": "Int64", "turn": "Int64"})

    return turns.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"),
        parts.cast(PARTS).alias("parts"),
    ).mapInPandas(formatted, FORMATTED)


def parse_turn(formatted: str) -> tuple:
    """(role, content) of a formatted turn, unescaped; placeholders stay."""
    if not (formatted.startswith(TURN) and formatted.endswith(f"{END}\n")):
        raise ValueError("not a formatted turn")
    role, _, content = formatted[len(TURN) : -len(END) - 1].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
    return role, unescape(content)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted turns in order: the digests of what was said and of the loss.

    Rows of a conversation meet in one task, which streams over them and holds a few digests. Turns that share
    a number are taken in the order of their role and text. Rows without a conv_id make one conversation.
    """

    def digests(frames):
        def closed():
            return (now, turns, said.hexdigest(), chars, loss.hexdigest(), length)

        now, begun = None, False
        for frame in frames:
            done = []
            for conv, text, start, end in zip(frame["conv_id"], frame["formatted"], frame["loss_start"], frame["loss_end"]):
                conv = None if pd.isna(conv) else int(conv)
                if not begun or conv != now:
                    if begun:
                        done.append(closed())
                    begun, now, turns, chars, length = True, conv, 0, 0, 0
                    said, loss = hashlib.sha256(), hashlib.sha256()
                role, content = parse_turn(text)
                said.update(f"{role}\n{content}\n".encode())
                learnt = unescape(text[start:end])
                loss.update(learnt.encode())
                turns, chars, length = turns + 1, chars + len(learnt), length + len(text)
            yield _frame(done)
        if begun:
            yield _frame([closed()])

    def _frame(rows):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    order = ["conv_id", "turn", "role", "formatted"]
    ordered = formatted.select(*order, "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions(*order)
    return ordered.mapInPandas(
        digests,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
