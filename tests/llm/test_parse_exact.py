"""The derivatives alone against the languages' own parsers, which only the tests use."""

import ast
import re
import tomllib
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import parsecheck

from test_parse import VALID, valid

#: What the regular expression cannot lex, so that the lexer by the language's rules must.
ONLY_EXACT = [
    "print(f'{1+1}')\n", "f'{a['b']:{w}.{p}}' f\"{x!r:>{n}}\" 'c'\n", "f'''{\n a:\n}'''\n", "x = f'{(lambda q: 1)}{a=}{b = !r}{c!=d}{e:%H:%M}{ {1: 2}[1] }'\n", "rf'\\{a}\\d'\n", "x = '\\N{BULLET}'\n", "x = f'\\N{BULLET}{a}'\n",
    "if a:\n  \tx\n  \ty\n", "x = 1 \\\n\n", "if a:\n    \\\n    x\n", "\f\nx = 1\n\fy = 2\n", "1if 1else 2\n", "x = [0x1for x in y]\n",
    "match x:\n    case -1+2j | 3j | f'a': pass\n", "def f(a, b=1, /, c=2, *d: *e): pass\n", "lambda a, /, b=1, *c, d, **e: 1\n", "type X[T: int, *Ts, **P] = int\n", "class A[T = int, *Ts = *b]: pass\n",
    "(a).b = [] = () = x\n", "'a'.b, f(x)[1:2, *y] = z\n", "(a): int = yield\n", "del (), [a.b], (c[d],)\n", "with (a as b, c as (d, *e)): pass\n",
]
#: Apart, as the language's own parser takes exponential time to say what is wrong in deep brackets.
DEEP = ["x = " + "(" * 150 + ")" * 150 + "\n", "".join(" " * i + "if a:\n" for i in range(90)) + " " * 90 + "b\n"]
TOML = [
    "[a.b.c]\n[a]\nb.x = 1\n", "[a]\nb.c = 1\n[a.b]\nd = 1\n", "[a]\nb.c = 1\n[a.b.d]\ne = 1\n", "a = {b = 1}\na.c = 2\n", "[[a]]\n[a]\n", "a = [1]\n[[a]]\n", "[[a]]\nb.c = 1\n[[a]]\nb.c = 1\n", "[[a.b]]\n[a]\nb.c = 1\n",
    "a = {b = {}, b.c = 1}\n", "a = {b.c = 1, b.d = 2}\n", "'a' = 1\n\"\\u0061\" = 2\n", "d = 2021-02-30\n", "d = 2020-02-29 05:00:00.5+07:00\n", "t = 07:32\n", 'a = "\\uD800"\n', 'a = """x"""""\n', 'a = """\\\n  x"""\n',
    "a = [[1], [[2]]]\n[[b]]\n[b.c]\n[[b]]\n[b.c]\n", "a = 0xDEAD_beef\nb = -1_0.5e+3\nc = +inf\n", "3.14 = 1\n",
]


def toml_valid(text):
    try:
        tomllib.loads(text)
        return True
    except ValueError:
        return False


def failure(lang, text):
    return parsecheck.checker().failure(lang, text)


def test_the_operator_holds_no_parser_of_the_languages():
    source = open(parsecheck.__file__).read()
    assert not re.search(r"^(?:import|from) (?:ast|tomllib|json|tokenize)\b|\bcompile\(.*exec", source, re.M)


@pytest.mark.parametrize("text", ONLY_EXACT + DEEP)
def test_the_grammar_takes_what_only_the_exact_lexer_tells(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert valid(text) and failure("Python", text) is None


_PIECES = ["(", ")", "[", "]", "{", "}", "'", '"', "f'", "{x", "!r}", ":", "=", ",", ".", "\\", "\n", "\t", "    ", "#", "not ", "1", "1_", "0x", "e5", "j", "*", "@", ":=", "lambda ", "yield ", "await ", "é", "$", "\f"]


@given(st.sampled_from(VALID + ONLY_EXACT), st.lists(st.tuples(st.integers(0, 120), st.integers(0, 3), st.sampled_from(_PIECES)), max_size=3))
@settings(max_examples=1500, deadline=None)
def test_edited_python_is_judged_as_by_the_language(text, edits):
    for at, drop, piece in edits:
        text = text[:at] + piece + text[at + drop :]
    assert (failure("Python", text) is None) == valid(text), repr(text)
    assert valid(text) or not parsecheck.checker().python.usual(text), repr(text)


@given(st.sampled_from(TOML), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 2), st.sampled_from(["[", "]", "{", "}", '"', "'", '"""', "=", ".", ",", "\n", "#", "1", "a", "_", "-", ":", " ", "\\", "\r", "[a]\n", "b.c = 1\n"])), max_size=3))
@settings(max_examples=1500, deadline=None)
def test_toml_is_judged_as_by_the_language(text, edits):
    for at, drop, piece in edits:
        text = text[:at] + piece + text[at + drop :]
    assert (failure("TOML", text) is None) == toml_valid(text), repr(text)


@pytest.mark.parametrize(
    "lang, text, stop",
    [
        ("Python", "print(f'{1+1}')\nx = 1\ndef g(:\n    pass\n", ("token", 3, ":")),
        ("Python", "type X[T] = int\nx = f'{a b}'\n", ("token", 2, "b")),
        ("Python", "if a:\n    b\n  c\n", ("token", 3, "c")),
        ("Python", "a = 1\nx = (1,\n\n", ("end", 4, "")),
        ("Python", "x = '''a\n", ("end", 2, "")),
        ("Python", "x = f'{1 +'\n", ("token", 1, "'")),
        ("Python", "if a:\n\tb\n        c\n", ("token", 3, "c")),
        ("TOML", "a = 1\nb = 2\na = 3\n", ("definition", 3, "a")),
        ("TOML", "a = 1\nb = \n", ("token", 2, "\n")),
        ("TOML", "a = [1,\n", ("end", 2, "")),
        ("TOML", "d = 2021-02-30\n", ("token", 1, "2021-02-30")),
    ],
)
def test_where_the_derivative_becomes_empty(lang, text, stop):
    assert failure(lang, text) == stop


def test_names_of_many_parts_are_checked():
    deep = "a." * 1200
    assert failure("TOML", deep + "b = 1\n") is None
    assert failure("TOML", deep + "b = 1\n" + deep + "b = 2\n")[0] == "definition"
    assert failure("TOML", f"x = '{deep}'\na = 1\na = 2\n") == ("definition", 3, "a")


def test_the_derivatives_decide(monkeypatch):
    """With a grammar that takes any token anywhere the finds vanish."""
    free = parsecheck.Checker()
    monkeypatch.setattr(free.json, "derive", lambda node, t: node)
    monkeypatch.setattr(free.json, "nullable", lambda node: True)
    for g in (free.python.line_grammar, free.python.block_grammar, free.toml):
        monkeypatch.setattr(g, "derive", lambda node, t: 1)
        monkeypatch.setattr(g, "nullable", lambda node: True)
    for lang, text in (("Python", "x = = 1\n"), ("Python", "def f(=):\n  pass\n"), ("Python", "if a:\nb\n"), ("TOML", "a = 1 2\n"), ("JSON", '{"a" 1}')):
        assert parsecheck.checker().failure(lang, text) is not None
        assert free.failure(lang, text) is None
