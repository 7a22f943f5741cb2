"""Chat formatting with compiled templates (operator 9).

Rows of a conversation are brought together in order of turn and stream through the compiled template one message at a time, so a
conversation of any length needs the memory of one Arrow batch. The formatted rows of a conversation, joined in order, are its text;
loss spans are the parts between generation markers. read_back() parses that text into turns again.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.chat_template import Template, unescape

#: User and assistant turns, and any other role by name. Texts and names are escaped, so a marker in them is never a marker.
DEFAULT = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}[ANS] {% generation %}{{ m.text | escape }}{% endgeneration %} [/ANS]"
    "{% else %}[ROLE {{ m.role | escape }}] {{ m.text | escape }} [/ROLE]{% endif %}"
    "{% endfor %}</s>"
)
_ANY = r"((?:[^\\<\[\]]|\\.)*)"
TURN = re.compile(rf"\[INST\] {_ANY} \[/INST\]|\[ANS\] {_ANY} \[/ANS\]|\[ROLE {_ANY}\] {_ANY} \[/ROLE\]", re.S)

FORMATTED = "conv_id long, position long, formatted string, loss_spans array<struct<start: int, stop: int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def in_order(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted_rows(batches, source: str):
    """A row is written when the next one is known, as the last one of a conversation takes what follows the loop."""
    template = Template(source)
    none = object()
    waiting: tuple | None = None
    now, position = none, 0

    def written(row: tuple, last: bool) -> tuple:
        conv, pos, role, text = row
        out = template.message({"role": role, "text": text}, pos == 0, last)
        return conv, pos, "".join(out.parts), [{"start": a, "stop": b} for a, b in out.spans]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "position", "formatted", "loss_spans"])

    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if waiting is not None:
                rows.append(written(waiting, conv != now))
            position = position + 1 if waiting is not None and conv == now else 0
            now, waiting = conv, (conv, position, role, text)
        yield to_batch(rows)
    if waiting is not None:
        yield to_batch([written(waiting, True)])


def format_conversations(conversations: DataFrame, template: str = DEFAULT) -> DataFrame:
    """One row per turn, in order: conv_id, position from 0, formatted (its share of the text) and loss_spans within it.

    Rows of a conversation go by turn; ties by role and text, missing turns first. Null roles and texts count as empty; rows without
    a conv_id are one conversation. Repeated rows are turns of their own. Other columns don't matter; an empty table gives an empty result.
    """
    Template(template)
    return in_order(conversations).select("conv_id", "role", "text").mapInArrow(lambda batches: formatted_rows(batches, template), FORMATTED)


def digests(batches):
    none = object()
    now, state = none, None

    def done() -> tuple:
        n, turns, chars, loss, total = state
        return now, n, turns.hexdigest(), chars, loss.hexdigest(), total

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        rows = []
        for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
            if conv != now or state is None:
                if state is not None:
                    rows.append(done())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_turns(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in spans:
                part = unescape(text[span["start"] : span["stop"]])
                state[2] += len(part)
                state[3].update(part.encode())
            state[4] += len(text)
        yield to_batch(rows)
    if state is not None:
        yield to_batch([done()])


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, unescaped. What stands between them is the markers of the whole conversation."""
    out = []
    for m in TURN.finditer(text):
        user, assistant, role, other = m.groups()
        out.append(("user", unescape(user)) if user is not None else ("assistant", unescape(assistant)) if assistant is not None else (unescape(role), unescape(other)))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation of format_conversations() with the default template, straight after it: digests of what its output says."""
    return formatted.mapInArrow(digests, DIGESTS)
