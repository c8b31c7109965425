"""Added spans beside base spans, in long runs and of long forms."""

import pytest

from cindergrid.llm import pii

LISTED = [f"555-{k:03d}-{1000 + k}" for k in range(20)]


@pytest.mark.parametrize("text, want", [
    ("4111111111111111 (415) 555-2671", [("card", "4111111111111111"), ("phone", "(415) 555-2671")]),
    ("10.1.2.3 415-555-2671", [("ip", "10.1.2.3"), ("phone", "415-555-2671")]),
    (" ".join(LISTED), [("phone", x) for x in LISTED]),
    ("x john.smith42 (at) mail.example (dot) com y", [("email", "john.smith42 (at) mail.example (dot) com")]),
    ("first.middle-last42 (at) mail.sub.example (dot) co (dot) uk", [("email", "first.middle-last42 (at) mail.sub.example (dot) co (dot) uk")]),
])
def test_spans_beside_others(spark, text, want):
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert sorted((s.start, s.kind, text[s.start:s.end]) for s in r.spans) == sorted((text.index(x), k, x) for k, x in want)
