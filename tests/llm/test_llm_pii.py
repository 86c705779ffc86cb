"""Spans that the network adds: other spellings than the patterns know, with other values than it was trained on."""

import numpy as np
import pytest

from prepspark.llm import pii

HELD_OUT = [
    ("phone", "(030) 123-45678"), ("phone", "089/4567890"), ("phone", "(0221) 9988776"), ("phone", "0711-334-55667"),
    ("email", "jane.doe (at) corp (dot) example (dot) com"), ("email", "info[at]shop.example"), ("email", "max_muster [at] firma.de"), ("email", "no-reply {at} news {dot} org"),
    ("card", "3782 822463 10005"), ("card", "4111/1111/1111/1111"), ("ip", "10[.]0[.]0[.]7"), ("ip", "192(.)168(.)17(.)254"),
]
CLEAN = [
    "born 1999-12-31, order 12345678, at 12:30", "pages 120-145 and 1.234.567,89 in all", "see ISBN 978-3-1614-8410-0 (2nd edition)", "we met (at) night and left at 7",
    "on 24.12.2023 and 3/4/1999", "version 2.10.3, build 4471", "a long number 123456789012 without meaning", "rooms 101, 102 and 103",
]


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_spellings_are_added_and_clean_texts_left_alone(spark, model):
    rows = [(k, f"Words before, then {s} and some words after it.") for k, (_, s) in enumerate(HELD_OUT)]
    rows += [(100 + k, f"Words before: {s} and after.") for k, s in enumerate(CLEAN)]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string"), model, ["doc_id"]).collect()}
    right = [k for k, (kind, s) in enumerate(HELD_OUT) if f"{kind}:19:{19 + len(s)}" in got[k].spans.split(",")]
    assert len(right) >= len(HELD_OUT) - 2, [HELD_OUT[k] for k in range(len(HELD_OUT)) if k not in right]
    assert all(got[k].n_added == 1 for k in right)
    assert sum(got[100 + k].n_added for k in range(len(CLEAN))) == 0
    assert got[0].n_phone == 0 and got[4].n_email == 0  # base counts tell the patterns only


def test_added_spans_are_redacted(spark, model):
    df = spark.createDataFrame([(1, "Call (030) 123-45678 or write.", 30)], "doc_id bigint, text string, n_chars bigint")
    assert pii.redact(df, model, size="n_chars").first().text == "Call <PHONE> or write."


def test_recall_and_precision_on_other_draws(model):
    rng = np.random.default_rng(12345)
    found = wrong = asked = 0
    for k in range(300):
        kind, s = pii.spelled(rng) if k % 2 else ("", pii.unrelated(rng))
        text = f"some words of a text {s} and then it goes on for a while"
        base = pii.base_spans(text)
        more = pii.added(model, [text], [base])[0]
        if kind and not base:
            asked += 1
            found += (kind, 21, 21 + len(s)) in more
        elif not kind:
            wrong += len(more)
    assert asked > 100 and found >= 0.8 * asked and wrong <= 3


def test_longest_span_lies_in_a_window():
    for lead in range(0, 120, 7):
        text = "x" * lead + " @" + "y" * (pii.WINDOW - pii.STRIDE - 2) + " " + "z" * 300
        assert any(s <= lead + 1 and lead + 1 + pii.WINDOW - pii.STRIDE <= s + pii.WINDOW for s in pii.window_starts(text))
