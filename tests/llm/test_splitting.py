import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filigree.llm.splitting import cut, split_texts


def units(text):
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def check(text, limit, overlap):
    raw, pieces = text.encode("utf-16-le", "surrogatepass"), cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == units(text)
    for a, b, _, piece in pieces:
        assert 0 < b - a <= limit and raw[2 * a : 2 * b] == piece.encode("utf-16-le", "surrogatepass")
    for (a, b, *_), (c, d, *_) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= overlap
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .,\n😀é。"), min_size=1, max_size=200), st.integers(2, 40), st.integers(0, 20))
def test_pieces_cover_and_overlap(text, limit, overlap):
    check(text, limit, min(overlap, limit // 2))


def test_boundaries_are_natural():
    text = "One two three. " * 30
    pieces = check(text, 100, 20)
    assert {k for _, _, k, _ in pieces[:-1]} == {"sentence"}
    assert all(p.startswith(("One", "two", "three")) for *_, p in pieces)
    assert {k for _, _, k, _ in check("x" * 50 + "\n\n" + "y" * 49, 60, 10)[:1]} == {"paragraph"}
    assert [k for _, _, k, _ in check("😀" * 100, 51, 10)][0] == "hard"
    assert cut("abc", 3, 1) == [(0, 3, "end", "abc")] and cut("", 5, 0) == [] == cut(None, 5, 0)
    with pytest.raises(ValueError):
        cut("abc", 10, 6)


def test_frame(spark):
    rows = [(1, "word " * 400, "k"), (1, "word " * 400, "k"), (2, None, None), (3, "", "t"), (4, "𝒳" * 401, "u"), (5, "𝒳" * 400, "v"), (6, "z" * 60_000, "w")]
    df = spark.createDataFrame(rows, "id long, body string, char_start string")
    got = split_texts(df, "body", ["id"])
    by = {}
    for r in got.collect():
        by.setdefault(r.id, []).append(r)
    assert len(by[1]) == 2 * len({r.piece_no for r in by[1]}) > 2
    assert [(r.char_start, r.char_end, r.piece_text) for r in by[2] + by[3]] == [(0, 0, "")] * 2
    assert [r.char_end for r in by[4]] == [800, 802] or by[4][0].char_end <= 800 and by[4][-1].char_end == 802
    assert len(by[5]) == 1 and by[5][0].text_units == 800
    assert sum(r.char_end - r.char_start for r in by[6]) >= 60_000 and len({r.text_units for r in by[6]}) == 1
    assert split_texts(df.limit(0), "body", ["id"]).count() == 0


def test_runs_that_fit_stay_whole():
    for head in ("word ", "a b word ", "w " * 350, "w " * 440):
        text = head + "x" * 797 + " tail"
        pieces = cut(text)
        assert all(kind != "hard" for _, _, kind, _ in pieces)
        assert any("x" * 797 in piece for *_, piece in pieces)
        assert all(e - s <= 800 and text[s:e] == piece for s, e, _, piece in pieces) and pieces[-1][1] == len(text)
        assert all(a[1] - 100 <= b[0] <= a[1] < b[1] for a, b in zip(pieces, pieces[1:]))
