"""Problem 4: source files that do not parse, by memoised parsing with derivatives.

A file is lexed into token kinds. For Python the logical lines are parsed first, each by its sequence of kinds, and the
sorts of line with their indentation form the token stream of the block grammar; lines and blocks recur in any corpus, so
nearly every derivative is a table lookup. JSON and TOML streams are parsed directly. The derivative alone decides: an
empty one gives the exact failing token; a last one that is not nullable means the text is cut short. What TOML says of
names (none defined twice, none extended after its definition) is no matter of grammar; it is checked on the same tokens.

Python is lexed twice at most. One regular expression lexes the usual file. What it cannot tell (f-strings with
expressions, tabs, form feeds, continued indentation, numbers before keywords), and any file that it makes the grammar
reject, is lexed by the rules of the language with a stack of f-string fields, and parsed by the same grammars.

Defined results: null contents are not judged; an empty Python or TOML text is valid, an empty JSON text is not; other
languages are not judged; a NUL character makes any file invalid; more than 200 open brackets or 100 levels of indentation
are no valid Python, as for the language's own parser; rows that repeat are judged each."""

from __future__ import annotations

import datetime
import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import grammars
from quern.llm.derivatives import EMPTY, Derivatives

_KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type _".split()
_OPS = "**= //= >>= <<= ... -> := ** // >> << += -= *= /= %= @= &= |= ^= == != <= >= + - * / % @ & | ^ ~ < > = ( ) [ ] { } , : . ;".split()
_PREFIX = r"(?:[uU]|[bB][rR]?|[rR][bBfF]?|[fF][rR]?)?"
_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])++|0[oO](?:_?[0-7])++|0[bB](?:_?[01])++|(?:[0-9](?:_?[0-9])*+\.(?:[0-9](?:_?[0-9])*+)?(?:[eE][+-]?[0-9](?:_?[0-9])*+)?|\.[0-9](?:_?[0-9])*+(?:[eE][+-]?[0-9](?:_?[0-9])*+)?|[0-9](?:_?[0-9])*+[eE][+-]?[0-9](?:_?[0-9])*+|(?:[1-9](?:_?[0-9])*+|0(?:_?0)*+)(?![0-9_.eE]))[jJ]?)(?!\w)"
_PY = re.compile(
    r"(?:[ \t]|\\\n)*+("
    rf"(?!{_PREFIX}[\"'])[^\W\d]\w*+"
    r"|(?:#[^\n]*+)?\n(?:[ \t]*+(?:#[^\n]*+)?\n)*+[ \t]*+"
    rf"|{_PREFIX}(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']|\\.|'(?!''))*+'''|\"(?!\"\")(?:[^\"\\\n]|\\.)*+\"|'(?!'')(?:[^'\\\n]|\\.)*+')"
    rf"|{_NUMBER}"
    r"|" + "|".join(map(re.escape, _OPS)) + r"|#[^\n]*+|[0-9][\w.]++|.)",
    re.S,
)
#: Line continuations whose place makes the lines hard to tell; the exact lexer reads them.
_ODD = re.compile(r"\\\n[ \t]*(?:\n|#|\Z)|\n[ \t]*\\\n|\A[ \t]*\\\n|\f")
_ESCAPES = re.compile(r"\\(?:N|x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U)")
_FIELD = re.compile(r"(?:[^{}\\]|\\[^N]|\{\{|\}\}|\{ *([A-Za-z_]\w*)(?:\.[A-Za-z_]\w*|\[[0-9]+\])* *(?:![rsa])?(?::[^{}\\\n]*)?\})*+", re.S)
_NAMES_IN_FIELDS = re.compile(r"[{.] *([A-Za-z_]\w*)")
_DEEP = 60

#: One character a kind, so that a line is a string: known words and marks by themselves, n d j s f b, \n, and ? for an error.
_CODE = {t: chr(0x100 + i) for i, t in enumerate([*_KEYWORDS, *_OPS])}
_NAME_OF = {v: k for k, v in _CODE.items()} | {c: c for c in "ndjsfb?"}
_OPEN, _CLOSE = [_CODE[c] for c in "([{"], [_CODE[c] for c in ")]}"]


def _string_kind(t: str) -> str:
    q = min(i for i in (t.find('"'), t.find("'")) if i >= 0)
    prefix, body = t[:q].lower(), t[q:]
    body = body[3:-3] if body[:3] in ('"""', "'''") and len(body) >= 6 else body[1:-1]
    if "b" in prefix and not t.isascii():
        return "?"
    if "r" not in prefix and "\\" in body and _ESCAPES.search(body):
        return "?"
    if "f" in prefix:
        if not _FIELD.fullmatch(body) or ("{" in body and any(x in _CODE and x not in ("match", "case", "type", "_") for x in _NAMES_IN_FIELDS.findall(body))):
            return "?"
        return "f"
    return "b" if "b" in prefix else "s"


class _Kinds(dict):
    """Token text -> kind; names and numbers are kept, up to a bound."""

    def __init__(self):
        super().__init__(_CODE)

    def __missing__(self, t: str) -> str:
        c = t[0]
        if t[-1] in "\"'" and len(t) > 1:
            return _string_kind(t)
        if c == "\n" or c == "#":
            return "\n" if "\n" in t else ""
        if "\n" in t:
            return "\n"
        if t.isidentifier():
            kind = "n"
        elif m := _NUMERAL.fullmatch(t):
            kind = "j" if m["j"] or m["i"] else "d"
        else:
            return "?"
        if len(self) > 300_000:
            self.clear()
            self.update(_CODE)
        self[t] = kind
        return kind


_THING = re.compile(r"\w[\w.+:-]*|.", re.S)


def _place(text: str, lo: int, hi: int) -> tuple[int, str]:
    """Line number and text of a token; what is no token is shown up to its end as a word."""
    return text.count("\n", 0, lo) + 1, text[lo : hi if hi > lo else _THING.match(text, lo).end()][:40]


class PythonParser:
    def __init__(self):
        self.kinds = _Kinds()
        self.line_grammar = Derivatives(grammars.PYTHON_LINE)
        self.block_grammar = Derivatives(grammars.PYTHON_BLOCK)
        self.sorts = re.findall(r"'(@\w+)'", grammars.PYTHON_LINE)
        self.sorts = list(dict.fromkeys(self.sorts))
        self.lines: dict[str, str] = {}
        self.depths: dict[str, int] = {}

    def line_sort(self, shape: str) -> str:
        """The sort of the logical line with these kinds, '' if no line has them."""
        got = self.lines.get(shape)
        if got is None:
            g = self.line_grammar
            node, _ = g.run("line", [_NAME_OF[c] for c in shape])
            got = "" if node == EMPTY else next((s for s in self.sorts if g.nullable(g.derive(node, s))), "")
            if len(self.lines) > 200_000:
                self.lines.clear()
            self.lines[shape] = got
        return got

    def depth(self, part: str) -> int:
        got = self.depths.get(part)
        if got is None:
            got = sum(part.count(c) for c in _OPEN) - sum(part.count(c) for c in _CLOSE)
            if len(self.depths) > 200_000:
                self.depths.clear()
            self.depths[part] = got
        return got

    def usual(self, text: str) -> bool:
        """Whether the derivatives accept the text as one regular expression lexes it; if not, exact() decides."""
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if "\x00" in text or "\\\n" in text and _ODD.search(text) or "\f" in text or text.endswith("\\"):
            return False
        toks = _PY.findall("\n" + text.rstrip(" \t"))  # blanks with no token after them would be tried from every place
        kinds = list(map(self.kinds.__getitem__, toks))
        ends = [t for t, k in zip(toks, kinds) if k == "\n"]
        parts = "".join(kinds).split("\n")
        if parts[0]:
            return False
        stream, stack, known = [], [0], self.lines
        tabs = spaces = False
        i, n = 1, len(parts)
        while i < n:
            shape, first = parts[i], i
            d = self.depth(shape)
            while d > 0 and i + 1 < n:
                i += 1
                shape += parts[i]
                d += self.depth(parts[i])
            i += 1
            if not shape:
                continue
            end = ends[first - 1]
            indent = len(end) - end.rfind("\n") - 1
            if indent:
                if end[-1] == "\t" or end[-indent] == "\t":
                    tabs = True
                if end[-1] == " " or end[-indent] == " ":
                    spaces = True
                if tabs and (spaces or end.count("\t", len(end) - indent) != indent) or not tabs and "\t" in end[-indent:]:
                    return False
            if indent > stack[-1]:
                stack.append(indent)
                stream.append(">")
            else:
                while indent < stack[-1]:
                    stack.pop()
                    stream.append("<")
                if indent != stack[-1]:
                    return False
            if len(stack) > _DEEP:
                return False
            sort = known.get(shape)
            if sort is None:
                if sum(shape.count(c) for c in _OPEN) > 40 and self._nesting(shape) > _DEEP:
                    return False
                sort = self.line_sort(shape)
            if not sort:
                return False
            stream.append(sort)
        stream += ["<"] * (len(stack) - 1)
        g = self.block_grammar
        node, _ = g.run("file", stream)
        return node != EMPTY and g.nullable(node)

    def exact(self, text: str) -> tuple[str, int, str] | None:
        """None if the text is valid, else (token or end, line number, token) where the derivative says that it is not."""
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        lines, blocks = self.line_grammar, self.block_grammar

        def fail(lo: int, hi: int) -> tuple[str, int, str]:
            return ("token", *_place(text, lo, hi))

        cut = ("end", text.count("\n") + 1, "")
        block, line, first = blocks.start("file"), -1, None
        for kind, lo, hi in lex_python(text):
            if kind in ("INDENT", "DEDENT"):
                block = blocks.derive(block, ">" if kind == "INDENT" else "<")
                if block == EMPTY:
                    return cut if lo >= len(text) else fail(lo, lo)
            elif kind == "EOF":
                return None if blocks.nullable(block) else cut
            elif kind == "\n":
                sort = next((s for s in self.sorts if lines.nullable(lines.derive(line, s))), "")
                if not sort:
                    return cut if lo >= len(text) else fail(lo, hi)
                block, line = blocks.derive(block, sort), -1
                if block == EMPTY:
                    return fail(*first)
            else:
                if line < 0:
                    line, first = lines.start("line"), (lo, hi)
                line = lines.derive(line, kind)
                if line == EMPTY:
                    return cut if kind == "end" else fail(lo, lo if kind == "?" else hi)
        return cut

    @staticmethod
    def _nesting(shape: str) -> int:
        d = most = 0
        for c in shape:
            d += (c in _OPEN) - (c in _CLOSE)
            most = max(most, d)
        return most


_WORD = re.compile(r"[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*+")
_QUOTE = re.compile(rf"({_PREFIX})(\"\"\"|'''|\"|')")
_BODY = {
    '"""': re.compile(r'(?:[^\\"]|\\.|"(?!""))*+"""', re.S),
    "'''": re.compile(r"(?:[^\\']|\\.|'(?!''))*+'''", re.S),
    '"': re.compile(r'(?:[^\\\n"]|\\.)*+"', re.S),
    "'": re.compile(r"(?:[^\\\n']|\\.)*+'", re.S),
}
_DIGITS = r"[0-9](?:_?[0-9])*+"
_NUMERAL = re.compile(rf"0[xX](?:_?[0-9a-fA-F])++|0[oO](?:_?[0-7])++|0[bB](?:_?[01])++|(?P<d>(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|{_DIGITS}[eE][+-]?{_DIGITS})(?P<j>[jJ])?|(?P<i>{_DIGITS}[jJ])|[1-9](?:_?[0-9])*+|0(?:_?0)*+")
#: Words that may follow a number at once.
_AFTER_NUMBER = re.compile(r"and|else|for|i[fns]|not|or")
_OP = re.compile("|".join(map(re.escape, _OPS)))
_BLANKS = re.compile(r"[ \t\f]*+(?:#[^\n]*+)?")
_LITERAL_STOP = re.compile(r"[{}\\\n\"']")
_ESCAPE = re.compile(r"\\(?:N\{([^}]*)\}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U([0-9a-fA-F]{8})|[^NxuU])", re.S)
_CLOSED = {")": "(", "]": "[", "}": "{"}
_MOST_OPEN, _MOST_INDENTS = 200, 100


def _escape_end(text: str, at: int, is_bytes: bool = False) -> int:
    """Where the escape that begins at the backslash at `at` ends; -1 if it is none."""
    if is_bytes:
        return at + 2 if text[at + 1 : at + 2] != "x" else at + 4 if re.match(r"[0-9a-fA-F]{2}", text[at + 2 : at + 4]) else -1
    m = _ESCAPE.match(text, at)
    if not m or m[2] and int(m[2], 16) > 0x10FFFF:
        return -1
    if m[1] is not None:
        try:
            if len(unicodedata.lookup(m[1])) != 1:
                return -1
        except KeyError:
            return -1
    return m.end()


def _plain_kind(prefix: str, body: str) -> str:
    is_bytes = "b" in prefix
    if is_bytes and not body.isascii():
        return "?"
    if "r" not in prefix:
        at = body.find("\\")
        while at >= 0:
            end = _escape_end(body, at, is_bytes)
            if end < 0:
                return "?"
            at = body.find("\\", end)
    return "b" if is_bytes else "s"


def lex_python(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of the tokens by the rules of the language: INDENT, DEDENT, \\n after a logical line, at last
    EOF; or ? for a text that is no token, or end where the text stops inside a token or bracket."""
    n, at, fresh = len(text), 0, True
    indents = [(0, 0)]
    # Open brackets, fields and formats, and f-strings as (quote, raw).
    inside: list = []
    said = False  # whether the logical line has a token
    while True:
        top = inside[-1] if inside else None
        if isinstance(top, tuple) or top == "format":
            quote, raw = next(x for x in reversed(inside) if isinstance(x, tuple))
            m = _LITERAL_STOP.search(text, at)
            if not m:
                yield "end", n, n
                return
            at, c = m.start(), m[0]
            if c == "\\":
                if text[at + 1 : at + 2] in ("{", "}"):
                    at += 1
                    if top != "format":
                        continue
                    c = text[at]
                else:
                    end = at + 2 if raw else _escape_end(text, at)
                    if end < 0:
                        yield "?", at, at + 2
                        return
                    at = end
                    continue
            if c in "\"'":
                if not text.startswith(quote, at):
                    at += 1
                elif top == "format":
                    yield "?", at, at + 1
                    return
                else:
                    yield "F>", at, at + len(quote)
                    inside.pop()
                    at += len(quote)
            elif c == "\n":
                if len(quote) == 3:
                    at += 1
                elif top == "format":
                    inside.pop()
                else:
                    yield "?", at, at + 1
                    return
            elif top != "format" and text.startswith(c * 2, at):
                at += 2
            elif c == "{":
                yield "{", at, at + 1
                inside.append("field")
                at += 1
            elif top == "format":
                yield "}", at, at + 1
                del inside[-2:]
                at += 1
            else:
                yield "?", at, at + 1
                return
            continue
        if fresh and not inside:
            fresh = False
            column = alternative = joined = 0
            while at < n:
                c = text[at]
                if c == " ":
                    column, alternative = column + 1, alternative + 1
                elif c == "\t":
                    column, alternative = (column // 8 + 1) * 8, alternative + 1
                elif c == "\f":
                    column = alternative = 0
                elif c == "\\" and text.startswith("\n", at + 1) and at + 2 < n:
                    joined = joined or column
                    at += 1
                else:
                    break
                at += 1
            if at < n and text[at] not in "#\n":
                column, alternative = (joined, joined) if joined else (column, alternative)
                if column > indents[-1][0]:
                    if alternative <= indents[-1][1] or len(indents) >= _MOST_INDENTS:
                        yield "?", at, at + 1
                        return
                    indents.append((column, alternative))
                    yield "INDENT", at, at
                else:
                    while column < indents[-1][0]:
                        indents.pop()
                        yield "DEDENT", at, at
                    if (column, alternative) != indents[-1]:
                        yield "?", at, at + 1
                        return
        at = _BLANKS.match(text, at).end()
        if at >= n:
            if inside:
                yield "end", n, n
                return
            if said:
                yield "\n", n, n
            for _ in indents[1:]:
                yield "DEDENT", n, n
            yield "EOF", n, n
            return
        c = text[at]
        if c == "\n":
            if not inside:
                if said:
                    yield "\n", at, at + 1
                said, fresh = False, True
            at += 1
            continue
        if c == "\\":
            if not text.startswith("\n", at + 1):
                yield "?", at, at + 1
                return
            at += 2
            if at >= n:
                yield "end", n, n
                return
            continue
        said = True
        m = _QUOTE.match(text, at)
        if m:
            prefix, quote = m[1].lower(), m[2]
            if "f" in prefix:
                yield "F<", at, m.end()
                inside.append((quote, "r" in prefix))
                at = m.end()
                continue
            body = _BODY[quote].match(text, m.end())
            if not body:
                yield "end" if len(quote) == 3 else "?", at, n if len(quote) == 3 else m.end()
                return
            yield _plain_kind(prefix, text[m.end() : body.end() - len(quote)]), at, body.end()
            at = body.end()
            continue
        m = _WORD.match(text, at)
        if m:
            yield m[0] if m[0] in _CODE else "n" if m[0].isidentifier() else "?", at, m.end()
            at = m.end()
            continue
        if c.isascii() and c.isdigit() or c == "." and text[at + 1 : at + 2].isascii() and text[at + 1 : at + 2].isdigit():
            m = _NUMERAL.match(text, at)
            end = m.end()
            follows = text[end : end + 1]
            if follows and (follows == "_" or not follows.isascii() or follows.isalnum()) and not _AFTER_NUMBER.match(text, end):
                yield "?", at, end + 1
                return
            yield "j" if m["j"] or m["i"] else "d", at, end
            at = end
            continue
        if top == "field" and c in ":}!" and not text.startswith("!=", at):
            if c == ":":
                yield "F:", at, at + 1
                inside.append("format")
            elif c == "}":
                yield "}", at, at + 1
                inside.pop()
            else:
                w = _WORD.match(text, at + 1)
                if not w or w[0] not in ("r", "s", "a"):
                    yield "?", at, at + 1
                    return
                yield "!" + w[0], at, w.end()
                at = w.end() - 1
            at += 1
            continue
        m = _OP.match(text, at)
        if not m or c in _CLOSED and (not inside or inside.pop() != _CLOSED[c]) or c in "([{" and len(inside) >= _MOST_OPEN:
            yield "?", at, at + 1
            return
        if c in "([{":
            inside.append(c)
        yield m[0], at, m.end()
        at = m.end()


_JSON = re.compile(r'[ \t\n\r]*+("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?(?![\w.+-])|true\b|false\b|null\b|[^ \t\n\r])', re.S)


def _json_kind(t: str) -> str:
    c = t[0]
    if c == '"' and len(t) > 1:
        return "s"
    return "d" if len(t) > 1 and c == "-" or c.isascii() and c.isdigit() else t if t in "{}[],:" or t in ("true", "false", "null") else "?"


_TOML_ESCAPE = r"\\(?:[\"\\bfnrt]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}"
_TOML_LINE = re.compile(rf"\"(?:[^\"\\\n\x00-\x08\x0b-\x1f\x7f]|{_TOML_ESCAPE}))*+\"|'[^'\n\x00-\x08\x0b-\x1f\x7f]*+'")
_TOML_LINES = re.compile(rf"\"\"\"(?:[^\"\\\x00-\x08\x0b-\x1f\x7f]|\"{{1,2}}(?!\")|{_TOML_ESCAPE}|[ \t]*\n))*+\"{{3,5}}|'''(?:[^'\x00-\x08\x0b-\x1f\x7f]|'{{1,2}}(?!'))*+'{{3,5}}")
_TOML_COMMENT = re.compile(r"#[^\n\x00-\x08\x0b-\x1f\x7f]*+")
_TOML_KEY = re.compile(r"[A-Za-z0-9_-]++")
_TOML_RUN = re.compile(r"[A-Za-z0-9_+\-.:]++(?: [0-9]{2}:[0-9:.Zz+\-]++)?")
_TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?"
_TOML_VALUE = re.compile(
    r"(?:true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?[0-9])*)(?:\.[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    rf"|([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?:[Tt ]{_TIME}(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?)?|{_TIME})\Z"
)
_NO_SCALAR = re.compile(r"(?<!\\)(?:\\\\)*\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8}))")
_UNESCAPED = re.compile(r"\\(?:([\"\\bfnrt])|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8}))")
_SHORT = dict(zip('"\\bfnrt', '"\\\b\f\n\r\t'))


def _scalars(t: str) -> bool:
    """Whether the escapes of a string name characters that are no surrogates."""
    return t[0] == "'" or all(x < 0xD800 or 0xDFFF < x < 0x110000 for m in _NO_SCALAR.finditer(t) for x in (int(m[1] or m[2], 16),))


def _toml_name(t: str) -> str:
    if t[0] == '"':
        return _UNESCAPED.sub(lambda m: _SHORT[m[1]] if m[1] else chr(int(m[2] or m[3], 16)), t[1:-1])
    return t[1:-1] if t[0] == "'" else t


def _toml_value(t: str) -> bool:
    m = _TOML_VALUE.match(t)
    if m and m[1]:
        try:
            datetime.date(int(m[1]), int(m[2]), int(m[3]))
        except ValueError:
            return False
    return m is not None


def lex_toml(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end); what a text can be depends on whether a key or a value is due."""
    n, at = len(text), 0
    inside: list[str] = []  # open arrays and inline tables
    keys, header, begun = True, "", False
    while at < n:
        c = text[at]
        if c in " \t":
            at += 1
            continue
        if c == "#":
            at = _TOML_COMMENT.match(text, at).end()
            if at < n and text[at] != "\n":
                yield "?", at, at + 1
                return
            continue
        kind, end = c, at + 1
        if c == "\n":
            kind = "l"
            if not inside:
                keys, header, begun = True, "", False
        elif keys and c == "[" and not inside and not begun:
            header = kind = "[[" if text.startswith("[[", at) else "["
            end = at + len(kind)
        elif keys and c == "]" and header:
            kind = "]]" if header == "[[" and text.startswith("]]", at) else "]"
            end, keys = at + len(kind), False
        elif keys and (c in "\"'" or _TOML_KEY.match(text, at)):
            m = (_TOML_LINE if c in "\"'" else _TOML_KEY).match(text, at)
            kind, end = ("k", m.end()) if m and _scalars(m[0]) else ("?", end)
        elif c == "=":
            keys = False
        elif c == "[":
            inside.append(c)
        elif c == "{":
            inside.append(c)
            keys = True
        elif c in "]}":
            if inside and inside.pop() == _CLOSED[c]:
                keys = False
        elif c == ",":
            keys = inside[-1:] == ["{"]
        elif c != ".":
            m = (_TOML_LINES if text.startswith(c * 3, at) else _TOML_LINE).match(text, at) if c in "\"'" else _TOML_RUN.match(text, at)
            if m and (_scalars(m[0]) if c in "\"'" else _toml_value(m[0])) and not keys:
                kind, end = "v", m.end()
            elif c in "\"'" and text.startswith(c * 3, at) and not keys and text.find(c * 3, at + 3) < 0:
                yield "end", at, n
                return
            else:
                kind = "?"
        elif not keys:
            m = _TOML_RUN.match(text, at)
            kind, end = "?", m.end()
        begun = begun or kind != "l"
        yield kind, at, end
        if kind == "?":
            return
        at = end


class _Table:
    """A table of the names defined so far; `section` is the header under which dotted keys opened it."""

    __slots__ = ("names", "explicit", "section")

    def __init__(self, explicit: bool = False):
        self.names: dict = {}
        self.explicit, self.section = explicit, -1


def toml_redefinition(text: str, tokens: list[tuple[str, int, int]]) -> int:
    """Index of the token at which an accepted text defines a name again or extends what is complete; -1 if nowhere.

    A name stands for a table, for a list of tables (the last one is meant), or for a value (None)."""
    root = current = _Table()
    section = 0
    path: list[str] = []
    opened: list = []  # of open arrays None, of open inline tables their names
    head = ""
    for i, (kind, lo, hi) in enumerate(tokens):
        if kind == "k":
            path.append(_toml_name(text[lo:hi]))
        elif kind in ("[", "[[") and not opened and not path and (i == 0 or tokens[i - 1][0] == "l"):
            head = kind
        elif head and kind in ("]", "]]"):
            section += 1
            table, name = root, path[-1]
            for p in path[:-1]:
                table = table.names.setdefault(p, _Table())
                table = table[-1] if isinstance(table, list) else table
                if table is None:
                    return i - 1
            known = table.names.get(name, False)
            if head == "[[":
                current = _Table(True)
                if known is False:
                    table.names[name] = [current]
                elif isinstance(known, list):
                    known.append(current)
                else:
                    return i - 1
            elif known is False:
                current = table.names[name] = _Table(True)
            elif not isinstance(known, _Table) or known.explicit or known.section >= 0:
                return i - 1
            else:
                current = known
                current.explicit = True
            head, path = "", []
        elif kind == "=":
            if opened:
                names, last = opened[-1], path[-1]
                for p in path[:-1]:
                    names = names.setdefault(p, {})
                    if names is None:
                        return i - 1
                if last in names:
                    return i - 1
                names[last] = None
            else:
                table = current
                for p in path[:-1]:
                    table = table.names.setdefault(p, _Table())
                    if not isinstance(table, _Table) or table.explicit or table.section not in (-1, section):
                        return i - 1
                    table.section = section
                if path[-1] in table.names:
                    return i - 1
                table.names[path[-1]] = None
            path = []
        elif kind == "[":
            opened.append(None)
        elif kind == "{":
            opened.append({})
        elif kind in ("]", "}"):
            opened.pop()
    return -1


class Checker:
    """Verdicts of one process; the tables of derivatives live as long as it does."""

    def __init__(self):
        self.python = PythonParser()
        self.json = Derivatives(grammars.JSON)
        self.toml = Derivatives(grammars.TOML)

    def failure(self, lang: str, text: str) -> tuple[str, int, str] | None:
        """None if the text is valid, else (why, line number, token): token where the derivative became empty, end where
        the text is cut short, definition where a name of TOML is defined again."""
        if lang == "Python":
            return None if self.python.usual(text) else self.python.exact(text)
        if lang == "JSON":
            node, k = self.json.run("value", map(_json_kind, _JSON.findall(text.rstrip(" \t\n\r"))))
            if node != EMPTY:
                return None if self.json.nullable(node) else ("end", text.count("\n") + 1, "")
            m = next(m for i, m in enumerate(_JSON.finditer(text)) if i == k)
            return "token", text.count("\n", 0, m.start(1)) + 1, m[1][:40]
        text = text.replace("\r\n", "\n")
        node, seen = self.toml.start("file"), []
        for t in lex_toml(text):
            node = self.toml.derive(node, t[0])
            if node == EMPTY:
                return ("end", text.count("\n") + 1, "") if t[0] == "end" else ("token", *_place(text, t[1], t[1] if t[0] == "?" else t[2]))
            seen.append(t)
        if not self.toml.nullable(node):
            return "end", text.count("\n") + 1, ""
        i = toml_redefinition(text, seen)
        return None if i < 0 else ("definition", *_place(text, seen[i][1], seen[i][2]))


@functools.lru_cache(maxsize=1)
def checker() -> Checker:
    return Checker()


def failures(df: DataFrame, id_col: str = "seq", text_col: str = "content", lang_col: str = "lang") -> DataFrame:
    """(id_col, why, line_no, token) of each row that is not valid in its language; one narrow pass."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = checker()
        for batch in batches:
            at, rows = [], []
            for i, (text, lang) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if text is not None and lang in ("Python", "JSON", "TOML"):
                    bad = check.failure(lang, text)
                    if bad:
                        at.append(i)
                        rows.append(bad)
            cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "why", "line_no", "token"])

    rows = df.select(id_col, text_col, lang_col).filter(F.col(lang_col).isin("Python", "JSON", "TOML"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, why string, line_no int, token string")


def rates(df: DataFrame, id_col: str = "seq", text_col: str = "content", lang_col: str = "lang", repo_col: str = "max_stars_repo_name") -> DataFrame:
    """(repo, lang, files, failed, rate): by repository and language, judged rows only; the null repository is a group."""
    kind = df.schema[repo_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = checker()
        for batch in batches:
            bad = [int(check.failure(lang, text) is not None) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(bad, pa.int32())], ["repo", "lang", "bad"])

    rows = df.filter(F.col(lang_col).isin("Python", "JSON", "TOML") & F.col(text_col).isNotNull()).select(text_col, lang_col, repo_col)
    out = rows.mapInArrow(run, f"repo {kind}, lang string, bad int").groupBy("repo", "lang")
    return out.agg(F.count(F.lit(1)).alias("files"), F.sum("bad").alias("failed")).withColumn("rate", F.col("failed") / F.col("files"))
