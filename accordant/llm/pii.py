"""Personal data: spans by pattern, and terms that reveal them by corpus co-occurrence.

Emails, IP addresses, card and phone numbers are found by pattern.  Each distinct value is a protected entity c.
A term t (a word) within WINDOW words of an entity co-occurs with it.  Over all documents,
PMI(c; t) = log2(p(c, t) / (p(c) p(t))) says how much t gives away about c, and the information content
IC(c) = -log2 p(c) is the most it can.  Their ratio is the disclosure: 1 if every document with t has c close
by.  Every pair is scored, also of an entity that stands in one document.  Terms at or above `generalise_from` are
replaced by their kind, at or above `remove_from` removed, wherever they stand as a word outside a span: in the whole
document, and in documents without the entity, where they give it away just as well.

Pairs come only from the words around entities, so they grow with the entities, not with documents times
terms.  Documents are counted for every term of the corpus, pre-aggregated in the tasks.  Telling terms are looked
for in each text through a bitmap of their hashes (4 bytes a term, broadcast), then joined exactly.

Documents that repeat count each.  Null texts count as empty.  Only the id and text columns are read; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, same, share

#: Words on each side of an entity that co-occur with it.
WINDOW = 6
#: Distinct terms that a task counts before it sends its counts on.
TERMS_HELD = 300_000
#: Bits of the bitmap for a telling term, and at most.
TERM_BITS, MOST_BITS = 32, 1 << 30

#: The base patterns (fixed values of the contract), made linear: an email is looked for at its @, and digits that
#: cannot start an IP address because digits stand before them are skipped.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\W_]+")
_TERM = re.compile(r"[^\W\d_]{3,}")
KINDS = ("email", "ip", "card", "phone")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            done = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then by start; code points, end exclusive."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0]) if len(m[0]) > 15 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> str:
    """The protected value: emails lower-cased, numbers by their digits."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else re.sub('[^0-9]', '', value)}"


def outside(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """A test whether a stretch of the text meets none of the spans."""
    held = sorted((s, e) for _, s, e in spans)
    starts, reach = [s for s, _ in held], list(accumulate((e for _, e in held), max))  # the furthest end of the spans so far

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)  # spans that start before its end
        return before == 0 or reach[before - 1] <= start

    return free


def near_terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the words within WINDOW words of each span, none of them inside a span."""
    out = []
    free = outside(spans)
    for kind, start, end in spans:
        value = entity(kind, text[start:end])
        width = 40
        while True:  # widen until WINDOW words or the text's end
            low = max(0, start - width)
            left = list(_WORD.finditer(text, low, start))
            if len(left) > WINDOW or low == 0:
                break
            width *= 2
        right = []
        for m in _WORD.finditer(text, end):
            right.append(m)
            if len(right) == WINDOW:
                break
        for m in left[-WINDOW:] + right:
            if _TERM.fullmatch(m[0]) and free(*m.span()):
                out.append((value, m[0].lower(), *m.span()))
    return out


_SPAN = "array<struct<kind: string, start: int, end: int>>"
_NEAR = "array<struct<entity: string, term: string>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    near = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
    for b in batches:
        spans, terms = [], []
        for text in b.column(2).to_pylist():
            own = base_spans(text)
            spans.append([dict(zip(("kind", "start", "end"), x)) for x in own])
            terms.append([dict(zip(("entity", "term"), x)) for x in near_terms(text, own)] if own else [])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, span), pa.array(terms, near)], ["id", "content", "base", "near"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents) of a task."""
    held: dict[str, int] = {}

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["term", "documents"])
        held.clear()
        return out

    for b in batches:
        for text in b.column(0).to_pylist():
            for t in {w.lower() for w in _TERM.findall(text)}:
                held[t] = held.get(t, 0) + 1
            if len(held) > TERMS_HELD:
                yield told()
    if held:
        yield told()


def term_spots(text: str, terms: set[str]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words that are one of the terms and don't touch a base span."""
    spots = [(m[0].lower(), *m.span()) for m in _WORD.finditer(text) if m[0].lower() in terms and _TERM.fullmatch(m[0])]
    if not spots:
        return []
    free = outside(base_spans(text))
    return [x for x in spots if free(x[1], x[2])]


def _spotted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask = 8 * len(bits) - 1
        held: dict[str, bool] = {}
        names = ["id", "content", "term", "start", "end"]
        for b in batches:
            own, spots = [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                maybe = set()
                for t in {w.lower() for w in _TERM.findall(text)}:
                    hit = held.get(t)
                    if hit is None:
                        at = zlib.crc32(t.encode()) & mask
                        hit = held[t] = bool(bits[at >> 3] >> (at & 7) & 1)
                    if hit:
                        maybe.add(t)
                if len(held) > TERMS_HELD:
                    held.clear()
                if maybe:
                    found = term_spots(text, maybe)
                    own += [k] * len(found)
                    spots += found
            at = pa.array(own, pa.int64())
            term, start, end = (pa.array([x[j] for x in spots], kind) for j, kind in enumerate((pa.string(), pa.int32(), pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), term, start, end], names)

    return run


def _bitmap(terms: DataFrame) -> bytes:
    """A bit for the hash of each term; a power of two of bytes."""
    size = 64
    n = terms.count()
    while size < min(TERM_BITS * n, MOST_BITS):
        size *= 2
    at = terms.select(F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(size - 1)).alias("at")).distinct().toArrow()["at"].to_numpy()
    bits = np.zeros(size, np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def find(documents: DataFrame, generalise_from: float = 0.8, remove_from: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, content (SHA-256 of the text), base (spans) and terms (spans of disclosing terms,
    kind `generalise` or `remove`, by start)."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("content", F.unhex(F.sha2("text", 256)))
    kind = docs.schema["id"].dataType.simpleString()
    found = materialise(docs.select("id", "content", "text").mapInArrow(_found, f"id {kind}, content binary, base {_SPAN}, near {_NEAR}").withColumn("row", F.monotonically_increasing_id()), "found")
    near = found.filter("size(near) > 0").select("row", F.explode("near").alias("x")).select("row", "x.*")
    pairs = materialise(near.distinct().groupBy("entity", "term").agg(F.count("*").alias("together")), "pairs")
    of_entity = near.select("row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    # Added up before the join: tasks times terms would meet in it otherwise.
    of_term = docs.select("text").mapInArrow(_counted, "term string, documents long").groupBy("term").agg(F.sum("documents").alias("with_term"))
    total = F.lit(float(found.count()))
    pmi = F.log2(F.col("together") * total / (F.col("with_entity") * F.col("with_term")))
    content = F.log2(total / F.col("with_entity"))
    scored = pairs.join(of_entity, "entity").join(of_term, "term").withColumn("disclosure", F.when(content > 0, pmi / content).otherwise(0.0))
    telling = scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(f"disclosure >= {generalise_from}")  # remove over generalise
    telling = materialise(telling.select("term", F.when(F.col("disclosure") >= remove_from, "remove").otherwise("generalise").alias("kind")), "telling")
    bits = share(documents.sparkSession, _bitmap(telling))
    spots = docs.select("id", "content", "text").mapInArrow(_spotted(bits), f"id {kind}, content binary, term string, start int, end int").join(telling, "term")
    # Equal rows have equal terms, so ids and contents are enough to lead them back.
    terms = spots.groupBy(F.col("id").alias("_id"), F.col("content").alias("_content")).agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("terms"))
    terms = terms.withColumn("terms", F.transform("terms", lambda t: F.struct(t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end"))))
    joined = found.join(terms, same(found, terms, {"id": "_id", "content": "_content"}), "left")
    return joined.select(F.col("id").alias(id_col), "content", "base", F.coalesce("terms", F.array().cast(_SPAN)).alias("terms"))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, base, terms in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            put = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base or []]
            for s in terms or []:
                term = text[s["start"] : s["end"]]
                put.append((s["start"], s["end"], "" if s["kind"] == "remove" else "[NAME]" if term[:1].isupper() else "[WORD]"))
            at, pieces = 0, []
            for start, end, instead in sorted(put):
                if start < at:  # spans of two kinds overlap: the first stands, the rest of the second goes
                    at = max(at, end)
                    continue
                pieces += [text[at:start], instead]
                at = end
            out.append("".join([*pieces, text[at:]]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "clean_text"])


def sanitise(documents: DataFrame, found: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, clean_text): base spans replaced by their kind, disclosing terms by [NAME] or [WORD], or removed."""
    found = find(documents, id_col=id_col, text_col=text_col) if found is None else found
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("content", F.unhex(F.sha2("text", 256)))
    own = found.filter("size(base) > 0 OR size(terms) > 0").select(F.col(id_col).alias("_id"), F.col("content").alias("_content"), "base", "terms").dropDuplicates(["_id", "_content"])
    joined = docs.join(own, same(docs, own, {"id": "_id", "content": "_content"}), "left").select("id", "text", "base", "terms")
    kind = docs.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_cleaned, f"id {kind}, clean_text string").withColumnRenamed("id", id_col)
