"""Spans, rewriting and edge cases of chat formatting, with templates that append, trim and rewrite."""

import time

import pytest

from accordant.llm import chat_format

SAID = "\\### Assistant: </turn> ok"


def turns_of(n):
    return [{"role": ("user", "assistant")[k % 2], "text": f"{SAID} {k}\n"} for k in range(n)]


def trims(turns):
    """Marks where the last turn ends, and takes the mark away again when another follows."""
    return "".join(f"[{t['role']}]{t['text']}" for t in turns) + "<end>" * bool(turns)


def rewrites_from(k):
    """A template that shortens the first turn once there are more than k turns."""
    return lambda turns: chat_format.default_template([{**t, "text": ""} if i == 0 and len(turns) > k else t for i, t in enumerate(turns)])


def plain(turns, render):
    """Spans by comparing all outputs character by character."""
    outputs = [render(turns[:k]) for k in range(len(turns) + 1)]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    found = [(common(a, b), len(b)) for a, b in zip(outputs, outputs[1:])]
    # A turn's span holds no longer once a later output differs before the span's end.
    held = [all(start >= end for start, _ in found[k + 1 :]) for k, (_, end) in enumerate(found)]
    return outputs[-1], [f if h else None for f, h in zip(found, held)], any(s < len(o) for (s, _), o in zip(found, outputs))


@pytest.mark.parametrize("n", [0, 1, 33, 200])
@pytest.mark.parametrize("render", [chat_format.default_template, trims, rewrites_from(40), rewrites_from(0)])
def test_spans_against_plain_comparison(n, render):
    turns = turns_of(n)
    found = chat_format.spans(turns, render)
    output, spans, rewrites = plain(turns, render)
    assert found["output"] == output == render(turns)
    assert found["rewrites"] == rewrites
    assert [s and (s["start"], s["end"]) for s in found["spans"]] == spans
    for t, s in zip(turns, found["spans"]):
        if s and s["text"] and render is trims:
            assert output[slice(*s["text"])] == t["text"]
        elif s and s["text"]:
            assert chat_format.unescape(output[slice(*s["text"])]) in (t["text"], "")


def test_a_late_rewrite_is_seen_in_spark(spark):
    rows = [(c, k, t["role"], t["text"]) for c in (1, 2) for k, t in enumerate(turns_of(70 if c == 1 else 30))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat_format.format_chats(df, rewrites_from(40)).collect()}
    assert (found[1]["rewrites"], found[2]["rewrites"]) == (True, False)
    assert found[1]["output"] == rewrites_from(40)(turns_of(70))


def test_long_conversations_take_little_time():
    at = time.time()
    found = chat_format.spans(turns_of(5000), chat_format.default_template)
    assert not found["rewrites"] and [s["end"] for s in found["spans"]][-1] == len(found["output"])
    assert time.time() - at < 60
    at = time.time()
    assert not chat_format.spans(turns_of(600), chat_format.default_template)["rewrites"]
    assert time.time() - at < 20


def test_turns_that_are_no_longer_kept_are_rendered_again(monkeypatch):
    monkeypatch.setattr(chat_format, "KEPT_CHARS", 100)
    turns = turns_of(60)
    assert chat_format.read_back(chat_format.spans(turns, chat_format.default_template)["output"]) == turns


def test_nulls_ties_clashes_and_empty_tables(spark):
    rows = [(1, 0, "user", "a", 9), (1, 1, None, None, 9), (1, None, "assistant", "first", 9), (None, 0, "user", "x", 9), (None, 0, "user", "x", 9), (2, 0, "assistant", "", 9), (3, 5, "assistant", "y" * 100_000, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, output int")
    read = {r["conv_id"]: r for r in chat_format.read_formatted(chat_format.format_chats(df)).collect()}
    assert read[1]["transcript"] == "assistant\nfirst\nuser\na\n\n\n" and read[1]["loss"] == "first"
    assert (read[None]["turns_read"], read[2]["loss"], read[2]["turns_read"]) == (2, "", 1)
    assert read[3]["loss"] == "y" * 100_000
    assert chat_format.format_chats(df.limit(0)).count() == 0
