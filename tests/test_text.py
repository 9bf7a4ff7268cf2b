import pytest

from quern.functions import text as T
from quern.operators import quality

TEXTS = ["", " ", "\n", "a", "a\n", "a\nb", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k", "\n\n", "  x\t y\u00a0z \n  # c\n\u3000", "e\u0301 \u2003 é\n", "\x1f#c\n a # b\n#\n", "x" * 1001 + "\n" + "y" * 1000, "a\x00b\n", "𝒙 é\n" * 3]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def column(rows, c):
    return [r[0] for r in rows.select(c.alias("c"), "i").orderBy("i").collect()]


def test_lines_counts_and_blanks_follow_python(rows):
    assert column(rows, T.lines("t")) == [t.splitlines() for t in TEXTS]
    assert column(rows, T.newline_count("t")) == [t.count("\n") for t in TEXTS]
    assert column(rows, T.strip("t")) == [t.strip() for t in TEXTS]
    assert column(rows, T.rstrip("t")) == [t.rstrip() for t in TEXTS]
    stats = column(rows, T.line_stats("t", 1000))
    assert [s["lines"] for s in stats] == [len(t.splitlines()) for t in TEXTS] and [s["long"] for s in stats] == [sum(len(x) > 1000 for x in t.splitlines()) for t in TEXTS]
    assert [s["solid"] for s in stats] == [sum(bool(x.strip()) for x in t.splitlines()) for t in TEXTS] and [s["marked"] for s in stats] == [sum(x.strip().startswith("#") for x in t.splitlines()) for t in TEXTS]
    assert column(rows, T.is_blank("t")) == [not t.strip() for t in TEXTS]


def test_normal_form(rows):
    import re
    import unicodedata

    assert column(rows, T.normalised("t")) == [re.sub(r"[^\S\n]+", " ", unicodedata.normalize("NFC", t)).strip() for t in TEXTS]


def test_function_names(spark):
    codes = ["def f(a):\n  pass", "x\n  def  g (b): pass\ndef h(): pass", "def (x)\ndef k(y)", "none", "", "def nope"]
    df = spark.createDataFrame(list(enumerate(codes)), "i int, t string")
    assert column(df, T.function_name("t")) == ["f", "g", "k", "solution", "solution", "nope"]


def test_prompts_and_stops(spark):
    p = ["def f():", 'd = """', "x = 1", "x\n    ", "y:\n    ", "z  "]
    df = spark.createDataFrame(list(enumerate(p)), "i int, t string")
    assert column(df, T.indented_prompt("t")) == ["def f():\n    ", 'd = """\n    ', "x = 1\n    ", "x\n    ", "y:\n    ", "z\n    "]
    q = spark.createDataFrame([(0, "a\nclass B\ndef c"), (1, "a\nif __name__"), (2, "a")], "i int, t string")
    assert column(q, T.truncated("t", ["\ndef ", "\nclass ", "\nif __name__"])) == ["a\nclass B", "a", "a"]
    assert column(q, T.inserted("t", "t", "class"))[2] == "a\na"


@pytest.mark.parametrize("text,reason", [("x" * 99, "length"), ("x" * 95 + "\n" * 4, "length"), (("x" * 20 + "\n") * 5, "comment_ratio"), ("# c\n" + ("x" * 20 + "\n") * 6, "passed"), (("x" * 1001 + "\n") + "# c\n" * 3 + "y\n", "passed"), (("x" * 1001 + "\n") * 2 + "# c\n" * 3 + "y\n" * 2, "line_length"), (("x" * 1000 + "\n") * 2 + "# c\n" + "y\n" * 3, "passed"), ("# " + "c" * 40 + "\n" + "\n" * 70, "comment_ratio"), ("# c" * 30 + "\n" + "# d\n" * 3 + "y\n", "passed"), ("  # c\n" * 5 + "x" * 90 + "\n" * 1, "comment_ratio"), ("x = 1 # c" * 20 + "\n" * 6, "comment_ratio")])
def test_first_failure(spark, text, reason):
    assert spark.createDataFrame([(text,)], "t string").transform(lambda d: quality.with_cheap_reason(d, "t")).first()["reason"] == reason


def test_cascade_needs_docstrings_of_one_tag_only(spark):
    good = "# c\n" + "x = 1\n" * 30
    rows = [(1, good, "stack"), (2, good, "curated"), (3, '"""D."""\n' + good, "stack"), (4, good + "def f(:\n", "curated"), (5, None, "stack"), (6, good, None), (7, good + "x\x00", "curated"), (8, 'def f():\n    ""\n' + good, "stack"), (9, "class A:\n    async def f(self):\n        'd'\n" + good, "stack")]
    df = spark.createDataFrame(rows, "seq int, content string, tag string")
    got = {r["seq"]: r["reason"] for r in quality.cascade(df, "content", "tag").collect()}
    assert got == {1: "docstring", 2: "passed", 3: "passed", 4: "syntax", 5: "length", 6: "passed", 7: "syntax", 8: "docstring", 9: "passed"}
    assert {r["reason"]: r["n"] for r in quality.counters(quality.cascade(df)).collect()}["docstring"] == 4
