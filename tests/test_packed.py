import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimark.operators.packed import STRAY_QUOTE, UNCLOSED, split_fields, split_packed

NAME = st.from_regex(r"[A-Za-z@._/-][A-Za-z0-9@._/-]{0,12}", fullmatch=True).filter(lambda x: x not in ("from", "import", "as"))


def plain(text, statements=False):
    return [v for v, _ in split_packed(text, statements)]


@pytest.mark.parametrize(
    "text,want",
    [
        (None, []), ("", []), (" \n", []), ("[]", []), ("{}", []), ("a,b", ["a", "b"]), (";a;;b,", ["a", "b"]), ("a | b\tc\r\nd", ["a", "b", "c", "d"]), ("{a,b}", ["a", "b"]),
        ("['a', 'b']", ["a", "b"]), ('["a","c-[\\"x\\"]"]', ["a", 'c-["x"]']), ('"a";"c-[""x""]"', ["a", 'c-["x"]']), ("['a', 'g-[1fr,auto]']", ["a", "g-[1fr,auto]"]), ("a,a, a", ["a", "a", "a"]), ("i-[2px;4px],b", ["i-[2px;4px]", "b"]), ("a b  c", ["a", "b", "c"]),
    ],
)
def test_spellings(text, want):
    assert plain(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("import json; from .a import A, LIMIT, DEPTH; from .b.c import B", ["import json", "from .a import A, LIMIT, DEPTH", "from .b.c import B"]),
        ("import re,from x.y import a, b,import z.t as tk,from .q import R", ["import re", "from x.y import a, b", "import z.t as tk", "from .q import R"]),
        ('"import os","from .a import B, C"', ["import os", "from .a import B, C"]),
        ("from a import (b, c)\nimport d", ["from a import (b, c)", "import d"]),
        ("import json from .x import Y", ["import json", "from .x import Y"]),
    ],
)
def test_statements(text, want):
    assert plain(text, True) == want


def test_malformed_fields_are_flagged_and_kept():
    assert split_packed('a,"b,c') == [("a", ""), ("b", STRAY_QUOTE), ("c", "")]
    assert split_packed("[a, b") == [("a", UNCLOSED), ("b", UNCLOSED)]


@settings(max_examples=200, deadline=None)
@given(st.lists(NAME, max_size=8), st.sampled_from([",", "; ", " | ", "\t", "\r\n", " "]), st.sampled_from(["", '"', "'"]), st.sampled_from(["", "[]", "{}"]))
def test_round_trip(names, separator, quote, wrap):
    text = separator.join(quote + n + quote for n in names)
    assert plain((wrap[:1] + text + wrap[1:]) if wrap else text) == names


def test_table(spark):
    rows = [("1", "r/a.ts", "a,b", None), ("1", "r/a.ts", "a,b", None), ("2", "r/b.py", "from x import a, b,import c", "q"), ("3", None, "", "z z"), (None, "r/c.ts", "k", None), ("4", "r/d.ts", "x," * 5000, "")]
    df = spark.createDataFrame(rows, "id string, source string, imports string, item string")
    got = [tuple(r) for r in split_fields(df, "id", ["imports", "item"], ("imports",), "source").collect()]
    assert sorted(x[:4] for x in got if x[0] in ("1", "2", "3")) == [("1", "imports", 1, "a"), ("1", "imports", 2, "b"), ("2", "imports", 1, "from x import a, b"), ("2", "imports", 2, "import c"), ("2", "item", 1, "q"), ("3", "item", 1, "z"), ("3", "item", 2, "z")]
    assert sum(x[0] == "4" for x in got) == 5000
    assert split_fields(df.limit(0), "id", ["imports"]).count() == 0
