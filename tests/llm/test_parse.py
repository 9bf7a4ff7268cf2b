import ast
import json
import tomllib
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import parsecheck
from quern.llm.derivatives import EMPTY, Derivatives

VALID = [
    "", "\n\n", "x = 1", "x = 1\n", "# only a comment", "def f(a, /, b, *, c=1, **k) -> int:\n    return a\n",
    "async def f():\n    async with a as b, c:\n        await d\n    async for x in y:\n        yield x\n",
    "match x:\n    case {'a': 1, **r} if r:\n        pass\n    case A(b, c=1) | [1, *_]:\n        pass\n    case _:\n        pass\n",
    "match = 3\ncase = match\ntype = case\n", "type X = int\n", "if (y := f(x)) > 1: pass\nelif z: pass\nelse:\n  pass\n",
    "a = [i for i in range(3) if i if not i]\nb = {**a, 1: 2}\nc = {*a, 1}\nd = *a, 1\n", "x: int = 3\nx.y: str\n", "lambda *a, b=1, **c: (yield)\n",
    "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "try:\n    pass\nexcept* A:\n    pass\n", "a = (\n  1,\n\n  # c\n  2)\n",
    "with (open(a) as b, open(c) as d):\n    pass\n", "print(f'{a.b!r:>10} {{}}', b'\\x00', r'\\d', 'a' 'b')\n", "x = 1 if a else 2; y = not a and b or c in d is not e\n", "@a.b(c)\n@d\nclass C(B, metaclass=M):\n    x = 1\n",
    "from . import a\nfrom ..b import (c as d, e,)\nfrom f import *\nimport g.h as i, j\n", "del a, b[1], (c)\nglobal q, r\nassert a, 'b'\n", "x = a[1:2, ::3, ...]\n", "f(*a, b, c=1, *d, **e)\nf(x for x in y)\n",
    "for a, *b in c, d:\n\tbreak\nelse:\n\tcontinue\n", "\r\nif a:\r\n  b\r\n", "größe = 'é'\n", "x = 0xFF + 0o7 + 0b1 + 1_000.5e-3j + .5 + 5.\n", "x = a \\\n  + b\n", "while True:\n    def g():\n        class D: pass\n    x\n",
]
INVALID = [
    "x = ", "def f(:\n  pass", "print 'x'", "if a:\npass", "  x = 1", "x = (1", "x = 1)", "x = '''a", "x = 'a\n", "def f(a=1, b): pass", "f(a=1, b)", "f() = 1", "a + b = 1", "for x in: pass", "class", "x = 01", "x = 1abc", "a b", "try:\n    pass\n",
    "except A, B:\n  pass", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> z\n", "if a:\n    x\n  y\n", "if a:\n\tx\n        y\n", "x\x00", "else:\n    pass", "x = `a`", "exec 'a'", "return = 1", "x = b'é'", "'a' b'b'", "import a.b as c.d", "from a import b,", "raise A, B", "x := 1", "(*a)", "match x:\n    pass", "@a\nx = 1", "async x = 1", "f(**a, *b)", "{a: 1, b}", "x = {1: 2, **}", "lambda a=1, b: 1", "def f(*): pass", "x = a\\ \n", "x = 1 \\\n",
]


def valid(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return False


@pytest.mark.parametrize("text", VALID)
def test_the_grammar_takes_valid_python_by_both_lexers(text):
    assert valid(text) and parsecheck.checker().python.usual(text) and parsecheck.checker().python.exact(text) is None


@pytest.mark.parametrize("text", INVALID)
def test_the_derivative_rejects_invalid_python(text):
    assert not valid(text)
    assert not parsecheck.checker().python.usual(text) and parsecheck.checker().failure("Python", text) is not None


@given(st.lists(st.sampled_from("x y 1 'a' ( ) [ ] { } : = == , . + - * ** not in is if else for def class return lambda print match case _ \n \n\x20\x20\x20\x20 async await @ := ; import from as pass".split(" ") + ["\n", "\n    "]), max_size=14))
@settings(max_examples=1500, deadline=None)
def test_token_streams_are_judged_as_by_the_language(tokens):
    text = " ".join(tokens)
    assert (parsecheck.checker().failure("Python", text) is None) == valid(text), repr(text)


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3), max_leaves=8), st.integers(0, 60), st.sampled_from(["", ",", "}", "]", "0", "\x01", "'", "NaN"]))
@settings(max_examples=300, deadline=None)
def test_json_is_exact(value, at, junk):
    text = json.dumps(value)
    check = parsecheck.checker()
    assert check.failure("JSON", text) is None
    text = text[:at] + junk + text[at:]
    try:
        json.loads(text, parse_constant=lambda c: 1 / 0)
        ok = not text.startswith("\ufeff")
    except (ValueError, ZeroDivisionError):
        ok = False
    assert (check.failure("JSON", text) is None) == ok, repr(text)


@pytest.mark.parametrize("text", ["", "a = 1", "[a.b]\nc = 'd'\n[[e]]\nf = [1, 2,\n 3]\ng = {x = 1, y.z = 2}\n", "d = 1979-05-27T07:32:00Z\nt = 07:32:00\n'q r'.\"s\" = 0x1F\nm = '''a\nb'''\n", "# c\n\na = true # d\n"])
def test_toml_valid(text):
    tomllib.loads(text)
    assert parsecheck.checker().failure("TOML", text) is None


@pytest.mark.parametrize("text", ["a = ", "a", "a = 1 b = 2", "[a", "a = [1,,2]", "a = {x = 1,}", "a = 1\na = 2", "[a]\n[a]", "a = 'x", "a = 01", "= 1", "a = \x01"])
def test_toml_invalid(text):
    assert parsecheck.checker().failure("TOML", text) is not None


def test_failing_token_and_truncation():
    check = parsecheck.checker()
    assert check.failure("Python", "a = 1\nprint 'x'\n") == ("token", 2, "'x'")
    assert check.failure("Python", "a = 1\ndef f():\n")[0] == "end"
    assert check.failure("JSON", '{"a": 1,\n "b" 2}') == ("token", 2, "2")
    assert check.failure("JSON", '{"a": [1, 2')[0] == "end"
    assert check.failure("JSON", "")[0] == "end"


def test_derivatives_of_a_small_grammar():
    g = Derivatives("e = '(' e ')' e | ")
    assert g.nullable(g.run("e", "(()())")[0])
    assert not g.nullable(g.run("e", "(()")[0])
    assert g.run("e", "())(")[1] == 2 and g.run("e", "())(")[0] == EMPTY


def test_rows(code):
    df = code([{"seq": 1, "content": "x = "}, {"seq": 2, "content": None}, {"seq": 3, "content": ""}, {"seq": 4, "content": "", "lang": "JSON"}, {"seq": 5, "content": "var x = ", "lang": "JavaScript"}, {"seq": 6, "content": "a = 1\n" * 20000}, {"seq": 6, "content": "x ="}, {"seq": 7, "content": "x", "lang": None}])
    assert sorted(r["seq"] for r in parsecheck.failures(df).collect()) == [1, 4, 6]
    rates = {(r["lang"]): (r["files"], r["failed"]) for r in parsecheck.rates(df).collect()}
    assert rates == {"Python": (4, 2), "JSON": (1, 1)}
    assert parsecheck.failures(code([])).count() == 0


@pytest.mark.parametrize("lang", ["Python", "JSON", "TOML"])
@pytest.mark.parametrize("text", [" " * 200000, "\n" * 200000, "x = 1" + " " * 200000, "# a" * 80000, "(" * 200000, "a." * 50000 + "b = 1", '"' * 100001])
def test_long_texts_take_linear_time(lang, text):
    import time

    began = time.time()
    parsecheck.checker().failure(lang, text)
    assert time.time() - began < 10


def test_toml_deep_name_in_a_string_leaves_the_check_of_names_on():
    check = parsecheck.checker()
    for quoted in ('x = "%s"\n', "# %s\n", 'x = """%s"""\n'):
        text = quoted % ("a." * 1200)
        assert check.failure("TOML", text + "b = 1\n") is None
        assert check.failure("TOML", text + "b = 1\nb = 2\n") is not None


@pytest.mark.parametrize("n", [400, 1000, 5000])
def test_toml_deep_nesting_is_no_failure(n):
    check = parsecheck.checker()
    assert check.failure("TOML", "x = " + "[" * n + "1" + "]" * n + "\n") is None
    assert check.failure("TOML", "x = " + "{a = " * n + "1" + "}" * n + "\n") is None
    assert check.failure("TOML", "x = " + "[" * n + "1" + "]" * (n - 1) + "\n") is not None
