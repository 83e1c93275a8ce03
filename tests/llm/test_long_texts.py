"""Very long texts and lines end in reasonable time and with defined results."""

import time

import pandas as pd

from spanloom.llm import credentials, handwritten, leakage, shared_spans, splitting, stuffing, syntax


def timed(limit, f, *args):
    began = time.time()
    out = f(*args)
    assert time.time() - began < limit, f
    return out


def test_long_lines():
    run = "Ab3dEf7hIj" * 60_000
    for text in (run + "%@=?", run + " @ % ? -----BEGIN ", "<a href=x> " * 40_000, "(" * 3_000, "curl " * 50_000, "a.b-" * 100_000 + "@", "x" * 500_000 + ":y@tcp("):
        assert timed(20, credentials.scan, text, "a.py") is not None
        timed(20, stuffing.stretches, text)
        timed(20, handwritten.measure, pd.Series([text]))
        pieces = timed(20, splitting.split_text, text, "a.js")
        assert "".join(p[3] for p in pieces) == text
    assert timed(20, shared_spans.anchors, [run])[0].size
    index = leakage.SeedIndex([(1, "a b c d e f g h i j k l m n")])
    assert timed(20, index.hits, leakage.words("a b c d e f g h " * 60_000))[0].size


def test_deep_and_long_sources():
    for language, text in (("javascript", "f(" * 30_000), ("typescript", "a<b>(c);\n" * 15_000), ("javascript", "f(1);" * 40_000), ("go", "package a\n" + "var x = 1\n" * 10_000), ("python", "(" * 10_000), ("json", "[" * 100_000), ("yaml", "a:\n" * 20_000 + "[" * 3_000)):
        assert timed(60, syntax.is_valid, text, language) in (True, False)
    assert syntax.is_valid("f(1);" * 40_000, "javascript") and not syntax.is_valid("f(" * 30_000, "javascript")
