"""Chat formatting with a black-box renderer, watched turn by turn.

A renderer is any function from a list of turns ({"role", "text"}) to one string.  Each conversation's successive
prefixes are rendered and consecutive outputs compared: what a turn appends is its span.  If an output does
not start with the one before, the template rewrites history; the conversation is marked, and from there on spans
are taken where the outputs still agree.  Within a span, the text's place is found by rendering the same prefix
with two one-character texts: what they share before and after the character is the template's.  Only assistant
texts are under the loss mask.

Conversations are grouped by id; a conversation is rendered in one task, as its output is one string.  Every prefix is
rendered, whatever a conversation's length, so time grows with the square of its turns; comparing two outputs takes
no Python step for a character, and as long as history stands only the new end is looked at.

Rows are ordered by turn (null first), then role, then text; a null text or role is empty; repeated rows are turns
of their own; rows with a null conversation id form one conversation.  Only these four columns are read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

Renderer = Callable[[list[dict]], str]

_ESCAPE = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_UNESCAPE = {"\\": "\\", "h": "#", "l": "<", "c": ":"}


#: Characters of rendered turns that a worker keeps, at most: successive prefixes render the same turns.
KEPT_CHARS = 16 << 20


def escape(text: str) -> str:
    """A text in which no control string of the template can stand."""
    return re.sub(r"[\\#<:]", lambda m: _ESCAPE[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\\hlc])", lambda m: _UNESCAPE[m[1]], text)


_turns: dict[tuple[str, str], str] = {}
_kept = 0


def _turn(role: str, text: str) -> str:
    """A rendered turn, kept for the prefixes to come; once KEPT_CHARS are held all are given up."""
    global _kept
    piece = f"### {escape(role)}: {escape(text)}</turn>\n"
    if _kept > KEPT_CHARS:
        _turns.clear()
        _kept = 0
    _turns[role, text] = piece
    _kept += len(piece)
    return piece


def default_template(turns: list[dict]) -> str:
    """### role: text</turn> for each turn, with control strings in roles and texts escaped."""
    return "".join([_turns.get((t["role"], t["text"])) or _turn(t["role"], t["text"]) for t in turns])


_TURN = re.compile(r"### ([^:]*): ([^<]*)</turn>\n")


def read_back(output: str) -> list[dict]:
    """The turns of a default_template output."""
    return [{"role": unescape(m[1]), "text": unescape(m[2])} for m in _TURN.finditer(output)]


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def spans(turns: list[dict], render: Renderer) -> dict:
    """The rendered conversation, each turn's span and its text's span in it, and whether history was rewritten.

    A turn that a later rendering changed has the span None.
    """
    before, out = render([]), []
    steady = True
    for k, turn in enumerate(turns):
        now = render(turns[: k + 1])
        start = len(before) if now.startswith(before) else shared(before, now)
        if start < len(before):
            steady = False
            out = [s if s is not None and s["end"] <= start else None for s in out]
        a, b = (render([*turns[:k], turn | {"text": c}]) for c in "ab")
        same = start if a[:start] == b[:start] == now[:start] else 0
        a, b, rest = a[same:], b[same:], now[same:]
        head = shared(a, b)
        tail = shared(a[::-1], b[::-1])
        whole = rest[:head] == a[:head] and head + tail <= len(rest) and rest[len(rest) - tail :] == a[len(a) - tail :] and len(a) == head + 1 + tail
        out.append({"start": start, "end": len(now), "text": (same + head, len(now) - tail) if whole else None})
        before = now
    return {"output": before, "spans": out, "rewrites": not steady}


_SCHEMA = "output string, rewrites boolean, roles array<string>, starts array<int>, ends array<int>, text_starts array<int>, text_ends array<int>"


def _rendered(render: Renderer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {name.split()[0]: [] for name in _SCHEMA.split(", ")}
            for turns in b.column(1).to_pylist():
                turns = [{"role": t["role"] or "", "text": t["text"] or ""} for t in turns]
                found = spans(turns, render)
                rows["output"].append(found["output"])
                rows["rewrites"].append(found["rewrites"])
                rows["roles"].append([t["role"] for t in turns])
                rows["starts"].append([s and s["start"] for s in found["spans"]])
                rows["ends"].append([s and s["end"] for s in found["spans"]])
                rows["text_starts"].append([s["text"][0] if s and s["text"] else None for s in found["spans"]])
                rows["text_ends"].append([s["text"][1] if s and s["text"] else None for s in found["spans"]])
            kinds = {"output": pa.string(), "rewrites": pa.bool_(), "roles": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, kinds.get(k, pa.list_(pa.int32()))) for k, v in rows.items()]], ["id", *rows])

    return run


def format_chats(conversations: DataFrame, render: Renderer = default_template, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: id, output, rewrites, and per turn its role, its span and its text's span (end exclusive)."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kind = grouped.schema["id"].dataType.simpleString()
    return grouped.mapInArrow(_rendered(render), f"id {kind}, {_SCHEMA}").withColumnRenamed("id", id_col)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        loss, turns, count = [], [], []
        for output, roles, starts, ends in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("output", "roles", "text_starts", "text_ends"))):
            loss.append("".join(unescape(output[s:e]) for r, s, e in zip(roles, starts, ends) if r == "assistant" and s is not None))
            read = read_back(output)
            count.append(len(read))
            turns.append("".join(f"{t['role']}\n{t['text']}\n" for t in read))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count, pa.int64()), pa.array(turns, pa.string()), pa.array(loss, pa.string())], [*b.schema.names, "turns_read", "transcript", "loss"])


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Rows of format_chats in the default template with what their outputs say: `turns_read`, `transcript` (role, newline,
    text, newline for each turn, parsed) and `loss` (the texts under the loss mask, cut out by the spans), unescaped."""
    return formatted.mapInArrow(_cut, StructType([*formatted.schema.fields, StructField("turns_read", LongType()), StructField("transcript", StringType()), StructField("loss", StringType())]))
