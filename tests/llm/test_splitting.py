import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import with_extra
from millrace.llm.splitting import RangeMax, boundary_strengths, pieces, split_lines, split_oversized


@given(st.text(alphabet="a\n\r ", max_size=60))
def test_lines_give_the_text_back(text):
    lines = split_lines(text)
    assert "".join(lines) == text
    assert len(lines) == text.count("\n") + (0 if text == "" or text.endswith("\n") else 1)


@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.data())
def test_range_maximum(values, data):
    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a, len(values) - 1))
    want = max(range(a, b + 1), key=lambda i: (values[i], i))
    assert RangeMax(np.array(values)).rightmost(a, b) == want


@settings(max_examples=200)
@given(st.lists(st.integers(0, 9), max_size=150), st.integers(1, 40), st.integers(0, 39))
def test_pieces_cover(strength, window, overlap):
    overlap = min(overlap, window - 1)
    got = pieces(np.array(strength, np.int32), window, overlap)
    if not strength:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(strength)
    assert all(0 < b - a <= window for a, b in got)
    assert all(nxt[0] == prev[1] - overlap for prev, nxt in zip(got, got[1:]))


def test_cut_falls_on_the_strongest_place():
    lines = split_lines("".join(f"\tx{i}\n" for i in range(8)) + "}\n\nfunc B() {\n" + "".join(f"\ty{i}\n" for i in range(8)) + "}\n")
    (a, b), *_ = pieces(boundary_strengths(lines), 12, 0)
    assert (a, b) == (0, 10)


def test_table(spark):
    text = "".join(f"line {i}\n" for i in range(25))
    items = with_extra(spark.createDataFrame([("a", text), ("a", text), ("b", "x\n" * 5), ("c", None), (None, text), ("d", "")], "id string, text string"), "ID", "arm_name")
    rules = spark.createDataFrame([("w", 10, 3, 10), ("n", 10, 3, None), (None, 10, 3, 1), ("o", None, None, 20), ("z", 4, 9, 24)], "arm_name string, window_lines int, window_overlap int, max_decl_lines int")
    got = split_oversized(items, rules).collect()
    assert {(r.arm_name, r.span_id) for r in got} == {("w", "a"), ("o", "a"), ("z", "a")}
    for arm, overlap in (("w", 3), ("o", 0), ("z", 3)):
        own = sorted((r for r in got if r.arm_name == arm), key=lambda r: r.piece_no)
        joined = own[0].text + "".join("".join(split_lines(r.text)[overlap:]) for r in own[1:])
        assert joined == text
    assert split_oversized(items, rules.limit(0)).count() == 0
    assert split_oversized(items.limit(0), rules).count() == 0
