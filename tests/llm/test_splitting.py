from hypothesis import given, settings
from hypothesis import strategies as st

from sedimark.llm.splitting import oversized, split_lines, split_oversized, split_text

LINES = st.lists(st.text("ab {};.\n\té", max_size=120), max_size=160).map("\n".join)


def check(text, max_lines, max_chars, overlap):
    pieces = split_text(text, max_lines, max_chars, overlap)
    lines = split_lines(text)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    assert "".join(piece[shared:] for _, _, shared, piece in pieces) == text
    done = 0
    for i, (a, b, shared, piece) in enumerate(pieces):
        begin = done - shared
        done = begin + len(piece)
        assert text[begin:done] == piece and 0 < len(piece) <= max_chars and b - a + 1 <= max_lines
        assert starts[a - 1] <= begin < starts[a] and starts[b - 1] < done <= starts[b]
        assert done == starts[b] or len(lines[b - 1]) > max_chars  # only a line that no piece can hold is cut within
        assert shared == 0 or begin == starts[a - 1]
        if i and done - len(piece) + shared in starts:  # one more line would not have fitted with the next one
            last = pieces[i - 1][1]
            if last - a + 1 < overlap and a > pieces[i - 1][0] + 1 and len(lines[last]) <= max_chars:
                more = lines[a - 2 : last + 1]
                assert len(more) > max_lines or sum(map(len, more)) > max_chars
    return pieces


@settings(max_examples=300, deadline=None)
@given(LINES, st.sampled_from([(50, 4000, 10), (8, 100, 3), (5, 60, 0), (12, 40, 10)]))
def test_no_text_lost_and_limits_hold(text, limits):
    check(text, *limits)


def test_cuts_at_sections_and_shares_ten_lines():
    body = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(40))
    pieces = check(body, 50, 4000, 10)
    assert len(pieces) == 3
    for (a, b, _, _), (c, _, _, _) in zip(pieces, pieces[1:]):
        assert b - c + 1 == 10
        assert split_lines(body)[b].startswith("def ")


def test_one_endless_line():
    pieces = check("x" * 30_000, 50, 4000, 10)
    assert len(pieces) == 8 and {p[:2] for p in pieces} == {(1, 1)}
    words = check("word " * 3000, 50, 4000, 10)
    assert all(p[3].endswith(" ") for p in words)


def test_the_rest_of_a_long_line_is_packed_with_the_lines_that_follow():
    text = "".join(f"line {i}\n" for i in range(60)) + "x y. " * 820 + "\n" + "".join(f"more {i}\n" for i in range(20))
    pieces = check(text, 50, 4000, 10)
    assert [p[:2] for p in pieces] == [(1, 50), (41, 61), (61, 81)]
    assert pieces[1][3].endswith("x y.") and pieces[2][2] == 0


def test_a_part_is_split_by_the_coarsest_separator_it_holds():
    """A section too large for a piece is split by paragraphs, a paragraph by lines, a line by sentences, then words."""
    section = "def f():\n" + "\n".join("    a = 1\n    b = 2\n    c = 3\n" for _ in range(30))
    pieces = check("x = 1\n\n" + section, 50, 4000, 0)
    assert all(p[3].endswith("c = 3\n\n") or p is pieces[-1] for p in pieces)
    sentences = check("One two three. " * 20, 50, 100, 0)
    assert all(p[3].rstrip().endswith(".") for p in sentences)
    words = check("one two three " * 20, 50, 100, 0)
    assert all(p[3].endswith(" ") for p in words)


def test_a_line_that_fits_is_never_cut():
    text = "".join("y" * 3900 + "\n" + "short\n" * 12 for _ in range(3))
    for a, b, _, piece in check(text, 50, 4000, 10):
        assert piece == "".join(split_lines(text)[a - 1 : b])


def test_table(spark):
    long = "\n".join(f"line {i}" for i in range(60))
    rows = spark.createDataFrame(
        [("a", 11, long, "x"), ("a", 11, long, "x"), ("b", None, long, "y"), ("c", 1, "short", "z"), ("d", 1, None, None), (None, 1, long, None), ("e", 1, "", "q"), ("f", 1, "y\n" * 50, "q")],
        "id string, start_line int, text string, piece string",
    )
    got = sorted((r.id, r.piece, r.start_line, r.end_line) for r in split_oversized(rows).collect())
    assert got == [("a", 1, 11, 60), ("a", 2, 51, 70), ("b", 1, 1, 50), ("b", 2, 41, 60)]
    assert oversized(rows).select("id").distinct().count() == 3
    assert split_oversized(rows.limit(0)).count() == 0
