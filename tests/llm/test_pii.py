"""Terms that reveal personal data, against brute force over whole documents."""

import math
import re
import time

from accordant.llm import pii
from tests.llm.test_queries import SF, plain_spans

ONCE = [
    (-1, "Report by Quillfeather, reach me at q.f@mail.example.com or ask the desk. " + "Some plain words follow here. " * 9 + "Signed Quillfeather."),
    (-2, "In other news Quillfeather was seen, and quillfeather9 too, with x.quillfeather@y.example.org around."),
    (-3, "The desk has some plain words."),
    (-3, "The desk has some plain words."),
    (None, "Nobody but Quillfeather"),
    (-4, None),
]


def brute(texts, generalise_from=0.8, remove_from=0.95):
    """(start, end, kind) of the telling terms of each text, from the definitions."""
    texts = [t or "" for t in texts]
    bases = [plain_spans(t) for t in texts]
    words = [[(m[0], *m.span()) for m in re.finditer(r"[^\W_]+", t)] for t in texts]
    is_term = lambda w: re.fullmatch(r"[^\W\d_]{3,}", w)
    having = [{w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)} for t in texts]
    with_entity, together, near = {}, {}, set()
    for d, (t, base) in enumerate(zip(texts, bases)):
        for kind, s, e in base:
            c = (kind, t[s:e].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", t[s:e]))
            with_entity.setdefault(c, set()).add(d)
            left, right = [w for w in words[d] if w[2] <= s or w[1] < s], [w for w in words[d] if w[1] >= e]
            for w, a, z in left[-6:] + right[:6]:
                if is_term(w) and not any(x < z and a < y for _, x, y in base):
                    together.setdefault((c, w.lower()), set()).add(d)
    best = {}
    for (c, t), docs in together.items():
        n, content = len(texts), math.log2(len(texts) / len(with_entity[c]))
        pmi = math.log2(len(docs) * n / (len(with_entity[c]) * sum(t in h for h in having)))
        best[t] = max(best.get(t, 0), pmi / content if content else 0)
    out = []
    for d in range(len(texts)):
        spots = [(a, z, best.get(w.lower(), 0)) for w, a, z in words[d] if is_term(w) and not any(x < z and a < y for _, x, y in bases[d])]
        out.append([(a, z, "remove" if v >= remove_from else "generalise") for a, z, v in spots if v >= generalise_from])
    return out


def test_terms_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + ONCE
    want = sorted(map(str, zip((i for i, _ in rows), brute([t for _, t in rows]))))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(str((r["doc_id"], [(t["start"], t["end"], t["kind"]) for t in r["terms"]])) for r in found) == want
    assert sum("[]" not in w for w in want) > 5


def test_a_rare_entity_is_protected_everywhere(spark):
    rows = ONCE + [(k, f"plain words some desk the has follow here number{k}") for k in range(400)]  # a term in three documents tells of an entity in one
    clean = {r["doc_id"]: r["clean_text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(clean) == len({i for i, _ in rows})
    assert "Quillfeather" not in clean[-1] + clean[-2] + clean[None] and "quillfeather9" in clean[-2] and "[EMAIL]" in clean[-2]
    assert clean[-3] == ONCE[2][1]


def test_the_query_lists_terms_of_every_document(spark):
    from accordant.llm import queries

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: ",".join(f"{k}:{a}:{z}" for a, z, k in x) for (i, _), x in zip(docs, brute([t for _, t in docs]))}
    assert {r["doc_id"]: r["term_spans"] for r in queries.op3_pii(spark, SF).collect()} == want
    assert any(want.values())


def test_long_numbers_and_many_values():
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]
    assert pii.base_spans("1" * 5000 + ".2.3.4") == [] and pii.base_spans("0.00.000.256") == []
    assert pii.base_spans("0.00.000.0255") == [("ip", 0, 13)]
    text = " ".join(f"word mail{k}@example.org" for k in range(20_000))
    at = time.time()
    spans = pii.base_spans(text)
    assert len(spans) == 20_000 and len(pii.near_terms(text, spans)) > 20_000
    assert time.time() - at < 10
    assert len(pii.term_spots(text, {"word"})) == 20_000


def test_words_that_touch_a_span_are_left_out():
    free = pii.outside([("a", 5, 9), ("b", 6, 20), ("c", 7, 8)])
    assert [free(*x) for x in ((0, 5), (0, 6), (10, 12), (19, 25), (20, 25))] == [True, False, False, False, True]
