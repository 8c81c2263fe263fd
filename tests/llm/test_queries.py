"""The registered queries on whole small tables, against SQL where there is some and brute force elsewhere."""

import hashlib
import os
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from accordant.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = queries.queries()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def result(spark, name):
    return {tuple(r)[0]: r.asDict() for r in QUERIES[name](spark, SF).collect()}


@pytest.fixture(scope="module")
def tables(spark):
    return {t: [r.asDict() for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()] for t in ("documents", "pages", "benchmark", "labels", "conversations")}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    out = QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    want = con.sql(queries.ORACLE[name])
    assert sorted(want.columns) == cols
    assert sorted(map(str, (tuple(r) for r in out.select(cols).collect()))) == sorted(map(str, want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()))


def test_url_rules(spark, tables):
    found = result(spark, "op1_url_filter")
    assert len(found) == len(tables["pages"])
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    for p in tables["pages"]:
        url = p["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in rules if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/") :])]
        best = max(fits, key=len, default=None)
        r = found[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best)
        assert r["verdict"] == rules[best] if best else r["verdict"] in ("allow", "block")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_personal_data(spark, tables):
    found = result(spark, "op3_pii")
    assert len(found) == len(tables["documents"])
    for d in tables["documents"]:
        base = plain_spans(d["text"] or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        r = found[d["doc_id"]]
        assert r["base_sha256"] == sha(said)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone")]
        terms = sorted((k, int(s), int(e)) for k, s, e in (x.split(":") for x in filter(None, r["term_spans"].split(","))))
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in [*base, *terms])


def test_chats_read_back(spark, tables):
    found = result(spark, "op7_chat_formatting")
    turns = {}
    for t in tables["conversations"]:
        turns.setdefault(t["conv_id"], []).append((t["turn"], t["role"] or "", t["text"] or ""))
    said = "\\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    assert found.keys() == turns.keys()
    for k, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        r = found[k]
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(rows), len(loss), sha(loss))
        assert r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for _, role, text in rows))


def test_tokens(spark, tables):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.tokenizer_file())
    coder.no_truncation()
    coder.no_padding()
    found = result(spark, "op9_bpe_coding")
    for d in tables["documents"]:
        ids = coder.encode(d["text"] or "", add_special_tokens=False).ids
        r = found[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)))
        assert r["decoded_sha256"] == sha(coder.decode(ids, skip_special_tokens=False))


def test_toxicity_scores_every_document(spark, tables):
    found = result(spark, "op8_toxicity")
    assert found.keys() == {d["doc_id"] for d in tables["documents"]}
    for k, r in found.items():
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7)


def test_toxicity_on_held_out_documents(spark):
    """Of documents that were not learnt from: most toxic ones are found, ordinary ones are left alone."""
    big = "/root/testdata/sf0.1"
    rows = QUERIES["op8_toxicity"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == k] for k in (1, 0))
    assert sum(r["predicted"] for r in toxic) > 0.4 * len(toxic)  # about half of these labels have no trace in the text
    assert sum(r["predicted"] for r in clean) < 0.01 * len(clean)


def test_quality_keeps_good_documents(spark):
    rows = QUERIES["op6_quality_classifier"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    good, bad = ([r for r in rows if r["quality"] == k] for k in (1, 0))
    assert sum(r["kept"] for r in good) > 0.995 * len(good)
    assert sum(r["kept"] for r in bad) < 0.2 * len(bad)


def test_pipeline_against_brute_force(spark, tables):
    from accordant.llm import ngram_join, quality
    from tests.llm.test_ngram_join import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(*quality.rated_sample(docs, spark.read.parquet(f"{SF}/labels.parquet"), queries.grade()))
    rows = [(r["doc_id"], r["text"]) for r in quality.grade(docs, model).collect() if r["_tail"] >= 0.5]
    best = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0d]", "", t or "")
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(t or ""), i))
    rows = [(i, t) for i, t in rows if (-len(t or ""), i) in best.values()]
    keep = {i for i, n, c in brute(rows, 5, 80) if i == c}
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for b in tables["benchmark"]:
        w = words(b["text"])
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    want = {i for i, t in rows if i in keep and not hit(words(t))}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert ngram_join and len(want) > 20
