"""Source files as rows: logical lines of Python source, and an index of physical lines.

Each distinct file goes through Python once, as a row of an Arrow batch, and leaves as rows; what is asked of it afterwards is
joined by keys.  (Spark doesn't take Arrow table functions on the right of a lateral join, so the table functions
are mapped over the files.)
"""

from __future__ import annotations

import io
import re
import tokenize
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import suppress
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions import text as T

#: Rows that a table function emits at a time, at most.
ROWS = 20_000
#: Tokens that are neither part of a statement nor its end.
_SILENT = [tokenize.NL, tokenize.COMMENT, tokenize.INDENT, tokenize.DEDENT]
#: Source of names, plain numbers, operators, brackets, spaces and comments in ASCII alone: nothing in it can't be read but for
#: brackets and margins, and a # always begins a comment.
_PLAIN = re.compile(r"(?:[-+*/%&|^~<>=.,:;@()\[\]{} \n]++|[A-Za-z_]\w*+|(?:0|[1-9][0-9]*+)(?![\w.])|#[\t -~]*+)*+", re.ASCII)
_BRACKETS = re.compile(r"[()\[\]{}]")
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: The tokenizer gives up at deeper margins and brackets than these, which are left to it.
_DEEP = 50
#: What may stand behind the margin of a blank line: nothing, or a line end of another kind.
_ENDS = {"", "\r", "\x85", "\u2028", "\u2029"}
#: Fingerprints are numbers in base 256 modulo this prime, which was drawn at random.
PRIME = 1983613069789375879


def _per_file(files: DataFrame, keys: list[str], given: list[str], kinds: dict[str, tuple[str, pa.DataType]], emit: Callable, seen: Accumulator | None) -> DataFrame:
    """emit(values of `given`) returns the rows of a file as lists, a list a column; rows of many small files leave together,
    those of a large one in pieces.  seen counts the files that went through."""
    schema = ", ".join([*[f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys], *[f"{c} {kind}" for c, (kind, _) in kinds.items()]])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if seen is not None:
                seen.add(b.num_rows)
            values = zip(*[b.column(n + j).to_pylist() for j in range(len(given))])
            owner, held = [], [[] for _ in kinds]

            def full() -> pa.RecordBatch:
                own = [b.column(k).take(pa.array(owner, pa.int64())) for k in range(n)]
                return pa.RecordBatch.from_arrays([*own, *[pa.array(c, kind) for c, (_, kind) in zip(held, kinds.values())]], [*keys, *kinds])

            for i, value in enumerate(values):
                found = emit(*value)
                for at in range(0, len(found[0]), ROWS):
                    if len(owner) >= ROWS:
                        yield full()
                        owner, held = [], [[] for _ in kinds]
                    owner += [i] * len(found[0][at : at + ROWS])
                    for c, column in zip(held, found):
                        c += column[at : at + ROWS]
            if owner:
                yield full()

    return files.select(*keys, *given).mapInArrow(run, schema)


def _plain_spans(source: str) -> list[tuple[int, int]] | None:
    """As statement_spans, at a fraction of its time, of source in which only brackets and margins tell logical lines; null for
    any other, and where these don't fit."""
    if not _PLAIN.fullmatch(source):
        return None
    found, margins, opened, first = [], [0], [], 0
    for n, line in enumerate(source.split("\n"), 1):
        code = line.lstrip(" ")
        if not code or code[0] == "#":
            continue
        if not opened:
            first, wide = n, len(line) - len(code)
            if wide > margins[-1]:
                margins.append(wide)
                if len(margins) > _DEEP:
                    return None
            while wide < margins[-1]:
                margins.pop()
            if wide != margins[-1]:
                return None
        if "#" in code:
            code = code.partition("#")[0]
        if "(" in code or ")" in code or "[" in code or "]" in code or "{" in code or "}" in code:
            for c in _BRACKETS.findall(code):
                if c not in _CLOSES:
                    opened.append(c)
                elif not opened or opened.pop() != _CLOSES[c]:
                    return None
            if len(opened) > _DEEP:
                return None
        if not opened:
            found.append((first, n))
    return None if opened else found


def statement_spans(source: str) -> list[tuple[int, int]]:
    """First and last lines (from 1) of the logical lines of Python source, up to the first token that can't be read."""
    plain = _plain_spans(source)
    return _spoken_spans(source) if plain is None else plain


def _spoken_spans(source: str) -> list[tuple[int, int]]:
    """The same from the tokens."""
    spoken = []
    with suppress(tokenize.TokenError, SyntaxError):
        for token in tokenize.generate_tokens(io.StringIO(source).readline):
            if token.type not in _SILENT:
                spoken.append((token.type == tokenize.NEWLINE, token.start[0]))
    ends = [k for k, (last, _) in enumerate(spoken) if last]
    # Behind each end begins the next line, unless it is an end itself.
    return [(spoken[a + 1][1], spoken[z][1]) for a, z in zip([-1, *ends], ends) if z > a + 1]


def _statements(source: str | None) -> tuple[list, list, list]:
    spans = statement_spans(source or "")
    lines = (source or "").split("\n")
    return [a for a, _ in spans], [z for _, z in spans], ["\n".join(lines[a - 1 : z]) for a, z in spans]


def logical_lines(files: DataFrame, keys: list[str], text: str = "text", seen: Accumulator | None = None) -> DataFrame:
    """(keys, start, end, body): the logical lines of each Python file, with their text as it stands."""
    kinds = {"start": ("int", pa.int32()), "end": ("int", pa.int32()), "body": ("string", pa.string())}
    return _per_file(files, keys, [text], kinds, _statements, seen)


def dedent(lines: list[str]) -> str:
    """As the column function `statements.dedented` of all these lines."""
    bare = [x.lstrip(" \t") for x in lines]
    if len(lines) == 1:
        return bare[0].rstrip()
    wide = len(commonprefix([x[: len(x) - len(b)] if b not in _ENDS else "" for x, b in zip(lines, bare) if b]))
    return "\n".join([b if b in _ENDS else x[wide:] for x, b in zip(lines, bare)]).lstrip("\n").rstrip()


def lines_in_turn(rows: DataFrame, keys: list[str], seen: Accumulator | None = None) -> DataFrame:
    """(keys, row, there, start, end, statement): of each row (keys, text, n, row) that stands behind the texts of its keys in a
    partition the logical line of that Python file that line n belongs to, as `dedent` leaves it, nulls where there is none.

    Rows whose `row` is null are texts; the first that isn't null counts, and `there` says whether there was any.  A file is cut
    when its first row comes, and only one file is held at a time, so a task's memory doesn't grow with the rows.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (*keys, "row")}
    schema = ", ".join([*[f"`{c}` {kind}" for c, kind in kinds.items()], "there boolean, start int, end int, statement string"])
    nowhere, lost = (True, None, None, None), (False, None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, there, text, starts, spans, lines, told = None, False, None, None, [], [], {}
        for b in batches:
            if not b.num_rows:
                continue
            own = [b.column(k) for k in range(len(keys))]
            changed = np.zeros(b.num_rows, bool)
            for c in own:  # null keys equal nothing
                changed[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)), True).to_numpy(zero_copy_only=False)
            changed[0] = held != [c[0].as_py() for c in own]
            held = [c[-1].as_py() for c in own]
            asks = pc.is_valid(b.column(len(keys) + 2)).to_numpy(zero_copy_only=False)
            numbers = b.column(len(keys) + 1).fill_null(0).to_numpy().tolist()
            found = []
            for i, (new, ask, said, n) in enumerate(zip(changed.tolist(), asks.tolist(), b.column(len(keys)).to_pylist(), numbers)):
                if new:
                    there, text, starts = False, None, None
                if not ask:
                    there, text = True, said if text is None else text
                    continue
                if not there:
                    found.append(lost)
                    continue
                if starts is None:
                    if seen is not None:
                        seen.add(1)
                    spans, lines, told = statement_spans(text or ""), (text or "").split("\n"), {}
                    starts = [a for a, _ in spans]
                k = bisect_right(starts, n) - 1  # spans of a file don't overlap
                if k < 0 or spans[k][1] < n:
                    found.append(nowhere)
                    continue
                if k not in told:
                    a, z = spans[k]
                    told[k] = (True, a, z, dedent(lines[a - 1 : z]))
                found.append(told[k])
            rest = b.filter(pa.array(asks))
            types = (pa.bool_(), pa.int32(), pa.int32(), pa.string())
            for at in range(0, len(found), ROWS):
                part = rest.slice(at, ROWS)
                said = [pa.array(c, kind) for c, kind in zip(zip(*found[at : at + ROWS]), types)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keys))], part.column(len(keys) + 2), *said], [*kinds, "there", "start", "end", "statement"])

    return rows.select(*keys, "text", "n", "row").mapInArrow(run, schema)


def fingerprint(raw: bytes) -> int:
    return int.from_bytes(raw, "big") % PRIME


def _indexed(lines: list[str], squashed: list[str]) -> tuple[list, ...]:
    raw = [x.encode() for x in squashed]
    sizes, prints = [0], [0]
    for x in raw:
        sizes.append(sizes[-1] + len(x))
        prints.append((prints[-1] * pow(256, len(x), PRIME) + fingerprint(x)) % PRIME if x else prints[-1])
    empty = [not x for x in raw]
    return list(range(1, len(lines) + 1)), lines, sizes[:-1], sizes[1:], prints[:-1], prints[1:], empty, [*empty[1:], False]


def line_index(files: DataFrame, keys: list[str], text: str = "text", seen: Accumulator | None = None) -> DataFrame:
    """(keys, pos, source_line, low, high, low_print, high_print, blank, blank_next): every physical line of each file.

    low and high are how many bytes stand before and up to the end of the line, without white space and with one kind of
    quote, and the prints are fingerprints of those bytes: what stands between two lines is told from differences.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    given = files.select(*keys, lines.alias("_lines"), F.transform(lines, T.squash).alias("_squashed"))
    long, flag = ("long", pa.int64()), ("boolean", pa.bool_())
    kinds = {"pos": ("int", pa.int32()), "source_line": ("string", pa.string()), "low": long, "high": long, "low_print": long, "high_print": long, "blank": flag, "blank_next": flag}
    return _per_file(given, keys, ["_lines", "_squashed"], kinds, _indexed, seen)


def between(low: Column, high: Column, squashed: Column) -> Column:
    """Whether the bytes between two fingerprints of the index are those of the squashed statement."""

    def run(low: pa.Array, high: pa.Array, squashed: pa.Array) -> pa.Array:
        out = []
        for a, z, text in zip(low.to_pylist(), high.to_pylist(), squashed.to_pylist()):
            raw = None if a is None or z is None or text is None else text.encode()
            out.append(None if raw is None else (a * pow(256, len(raw), PRIME) + fingerprint(raw)) % PRIME == z)
        return pa.array(out, pa.bool_())

    run.__annotations__ = {"low": pa.Array, "high": pa.Array, "squashed": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "boolean")(low, high, squashed)
