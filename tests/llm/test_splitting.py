"""Pieces: within the limit, complete, overlapping, cut where the boundary is strongest."""

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from lodestitch.llm import splitting as S

TEXTS = st.text(st.sampled_from("ab {};\n\r\n\té漢\U0001f600"), max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(4, 60), st.integers(0, 3))
def test_pieces(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    assert all(len(p.encode()) <= limit for _, _, p in pieces)
    # each piece begins with a suffix of what is there already and adds something new, in some way
    ends = {0}
    for first, last, p in pieces:
        assert 0 <= first <= last
        ends = {a + len(p) for e in ends for a in range(max(0, e - len(p) + 1), e + 1) if text[a : a + len(p)] == p}
        assert ends
    assert len(text) in ends


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.data())
def test_range_max(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    best = max(values[lo : hi + 1])
    assert S.RangeMax(np.array(values)).rightmost(lo, hi) == max(k for k in range(lo, hi + 1) if values[k] == best)


def test_cuts_between_functions_and_overlaps_by_lines():
    body = "".join(f"function f{k}() {{\n  a();\n  b();\n}}\n\n" for k in range(10))
    pieces = S.split_text(body, 120, 0)
    assert all(p.startswith("function") for _, _, p in pieces)
    for (_, last, _), (first, _, _) in zip(pieces, pieces[1:]):
        assert first == last + 1
    pieces = S.split_text(body, 120, 2)
    for (_, last, p), (first, _, q) in zip(pieces, pieces[1:]):
        assert first == last - 1 and p.splitlines()[-2:] == q.splitlines()[:2]


def test_split_oversized(spark):
    schema = "id long, kind string, content string, start_line long, end_line long, chunk_id string, piece string"
    text = "x = 1;\n" * 10
    rows = [(1, " Class-Headers", text, 5, 14), (2, "ClassHeader", text, None, 14), (3, "import", text, None, None), (4, "imports", "short", 1, 1), (5, "odd", text, 1, 10), (6, None, text, 1, 10), (7, "imports", None, 1, 1), (8, "imports", "", 1, 1)]
    items = spark.createDataFrame([(*r, "c", "p") for r in rows], schema)
    limits = spark.createDataFrame([("class_header", 30, 1), ("imports", 28, 0)], "kind string, max_bytes long, overlap_lines long")
    got = {}
    for r in S.split_oversized(items, limits).orderBy("chunk_id", "piece").collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert set(got) == {1, 2, 3}
    assert [(r.start_line, r.end_line) for r in got[1]] == [(5, 8), (8, 11), (11, 14)] == [(r.start_line, r.end_line) for r in got[2]]
    assert [(r.start_line, r.kind, r.n_bytes) for r in got[3]] == [(None, "imports", 28), (None, "imports", 28), (None, "imports", 14)]
    assert S.split_oversized(items.limit(0), limits).count() == 0


def test_long_lines_are_cut_by_the_index_too():
    line = "!function(e,t){var n=1;" + "function a(b,c){return b+c;}x=a(1,2),y=[3,4];" * 60
    pieces = [p for _, _, p in S.split_text(line, 200, 2)]
    assert "".join(pieces) == line and all(len(p) <= 200 for p in pieces)
    assert all(p.endswith(";") for p in pieces[:-1])  # the strongest mark of the window, not the last one
    assert [p for _, _, p in S.split_text("x" * 25 + ";" + "y" * 8, 10, 0)] == ["x" * 10, "x" * 10, "xxxxx;", "y" * 8]


def test_contradicting_line_numbers():
    text = "a\nb\nc\n"
    assert S._first_line(5, 7, text) == 5 and S._first_line(None, 7, text) == 5 and S._first_line(0, 7, text) == 5
    assert S._first_line(9, 7, text) == 5 and S._first_line(-1, 1, text) is None and S._first_line(None, None, text) is None
    assert S._first_line(9, 1, text) == 9
