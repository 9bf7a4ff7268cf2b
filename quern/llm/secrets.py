"""Problem 6: credentials in source code, found by subword density and context, and masked in place.

A public tokenizer spells natural words with few subwords and random strings with many, so characters per subword tell
unnatural strings. Every candidate is scored by them; its context (the format of a provider, the name that a value is given
to, the header, URL, parameter or comment that carries it) says under how many characters per subword it is believed: see
``LIFT``. Nothing is found that its density does not let pass. Each find is an interval of the text; masking replaces
letters and digits inside it one for one, so offsets, line numbers, escapes and quotes stay and the code around it keeps
its meaning.

Defined results: null and blank contents hold nothing; one row a line however many secrets begin there; placeholders,
masked and empty values, names, interpolations, values read at run time, public keys, checksums and ids are not finds; a
literal in three or more parts that are lines of an encoder (as wide as each other, 60 to 80 characters) is encoded data.
Values and names may have any length."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.encode import encoder, vocabulary

#: Formats that providers give to their tokens (fixed values).
FORMATS = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{18,}|xox[abeoprs]-[A-Za-z0-9-]{16,}"
    r"|(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}|sk_test_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{24,}|AIza[A-Za-z0-9_-]{30,}|ya29\.[A-Za-z0-9_-]{20,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r"|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{40,}|hf_[A-Za-z0-9]{28,}|dop_v1_[a-f0-9]{40,}|shpat_[a-fA-F0-9]{28,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{6,})"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----((?:\\[nr]|[\s\"'+,\\#*]|[A-Za-z0-9+/=:.-](?!----))*)(?:-----END)?")
URL = re.compile(r"(?<=[A-Za-z0-9])://([^\s:/@'\"<>{}$%]*+):([^\s@/'\"]++)@[A-Za-z0-9\[]")
HEADER = re.compile(r"(?i)\b(bearer|basic|token)\s+([A-Za-z0-9+/=_.~-]{12,})")
#: What may stand between the end of a name and its value.
VALUE = re.compile(r"[\"'\]]*[ \t]*(?::[ \t]*[A-Za-z_][\w.]*[ \t]*(?==))?(?:=>|:=|=(?!=)|:|,(?=[ \t]*[\"']))[ \t]*(\(\s*)?[rRbBuU]{0,2}([\"'])((?:(?!\2)[^\\\n]|\\.)+)\2")
_NAME = re.compile(r"[\w-]*+")
#: What a name, a sentence or a parameter of a credential begins with, in lower case; the patterns below start there.
HINT = re.compile(r"passw|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|signing[_-]?key|encryption[_-]?key|(?<![a-z])(?:pass|key|login|user|account|creds?|sig)(?![a-z])|(?<![a-z])user(?:name)?(?![a-z])|accountkey|sharedaccesskey")
BARE = re.compile(r"(?i)[ \t]*(?:[-*#;]+[ \t]*|//[ \t]*)?(?:export[ \t]+|env[ \t]+|set[ \t]+)?([\w.-]*(?:passw(?:or)?d|passwd|passphrase|pwd|pass|secret|token|api[_-]?key|access[_-]?key)[\w.-]*)[ \t]*(?:=|:[ \t])[ \t]*([^\s\"'(){}\[\]<>$,;][^\s\"'(){}\[\]<>,;]*)[ \t]*(?:\r?\n|\Z)")
PROSE = re.compile(r"(?i)(?:passw(?:or)?d|passwd|pwd|pass|login|credentials?)(?:[ \t]+is)?[ \t]*[:=]?[ \t]+([^\s\"'(){}\[\]<>$,;]+[0-9!#$%&*][^\s\"'(){}\[\]<>$,;]*)")
PAIR = re.compile(r"(?i)(?:user(?:name)?|login|account|creds?|credentials?)\b[ \t]*[:=]?[ \t]*([\w.@-]+)[ \t]*(?:/|:)[ \t]*([^\s\"'(){}\[\]<>$,;]{6,})")
INSIDE = re.compile(r"(?i)(?:password|passwd|pwd|secret|api_key|apikey|token|sig|accountkey|sharedaccesskey)=([^\s;&\"'<>{}()\[\]$,]+)")
_MORE = re.compile(r"\s*(?:[+][ \t]*)?[rRbBuU]{0,2}([\"'])((?:(?!\1)[^\\\n]|\\.)+)\1")
_FORMAT_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "_live_", "sk_test_", "sk-", "AIza", "ya29.", "SG.", "npm_", "pypi-", "hf_", "dop_v1_", "shpat_", "eyJ")

#: Names whose values are no secrets though they hold a word for one.
_NOT_A_SECRET = re.compile(r"(?:url|uri|field|file|path|name|label|column|header|hint|regex|pattern|param|length|len|size|type|kind|count|limit|format|prompt|env|var|ttl|expiry|expires|endpoint|sha\d*|md5|hash|checksum|digest|fingerprint|commit|hashed)\Z|public[_-]?key|hashed[_-]|(?:^|[_-])(?:sha\d+|md5)(?:[_-]|\Z)")
_PASSWORD_NAME = re.compile(r"passw|passphrase|passcode|pwd|(?<![a-z])pass(?![a-z])")
_TOKEN_NAME = re.compile(r"secret|token|api[_-]?key|access[_-]?key|(?:private|signing|encryption)[_-]?key")
#: What stands for a value: masks, interpolations and the words that manuals use.
_PLACEHOLDER = re.compile(
    r"(?i)\A(?:[*x.#_\-\s]+|<.*>|\[.*\]|\{.*\}|\$.*|%[sd(].*|%\w+%|.*\{[^}]*\}.*|(?:your|my|insert|enter|put|the)[_ .-][\w .-]*|.*(?:change_?-?me|placeholder|example|dummy|redacted|hidden|todo|fixme|_here|xxxx|\*{4}|\.\.\.).*"
    r"|(?:pass(?:word|wd)?|secret|token|test(?:ing|er)?|none|null|nil|true|false|undefined|default|admin|root|guest|user(?:name)?|n/?a|foo(?:bar)?|bar|qwerty|abc|123)\d{0,4})\Z"
)
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z")
_REFERENCE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\(?")

#: Characters per subword under which a string of letters alone, or in no telling context, is unnatural.
UNNATURAL = 2.0
#: What a context adds to that, for values of letters alone and for values in which digits or marks stand beside letters (as a
#: person makes a password of words): the better the context tells, the more natural a value may be.
LIFT = {"format": (0.6, 0.6), "block": (0.5, 0.5), "url": (1.0, 3.2), "password": (0.3, 3.2), "token": (0.0, 2.6), "prose": (-2.0, 3.2), "header": (0.0, 0.0), "key": (0.0, 0.0), "reference": (-0.6, 0.0)}
#: Characters that a value must have at least, by its context.
LEAST = {"format": 16, "block": 40, "url": 1, "password": 6, "token": 8, "prose": 6, "header": 12, "key": 16, "reference": 6}


class Finder:
    def __init__(self, path: str):
        self.encoding = encoder(path).encoding
        self.known: dict[str, float] = {}

    def density(self, value: str) -> float:
        """Characters per subword; capitals alone are read as small letters."""
        got = self.known.get(value)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            plain = value.lower() if not any(map(str.islower, value)) and not any(map(str.isdigit, value)) else value
            got = self.known[value] = len(value) / max(1, len(self.encoding.encode_ordinary(plain)))
        return got

    def secret(self, value: str, context: str) -> bool:
        """Whether the value is unnatural enough for its context."""
        if len(value) < LEAST[context] or "://" in value or any(map(str.isspace, value)) or _PLACEHOLDER.match(value):
            return False
        letters = any(map(str.isalpha, value))
        mixed = letters and (any(map(str.isdigit, value)) or re.search(r"[^\w./:-]", value) is not None)
        if context != "url" and (not letters or len(set(value)) < (5 if context in ("password", "prose") else 6)):
            return False
        if context == "token" and not mixed and len(value) < 12:
            return False
        return self.density(value) < UNNATURAL + LIFT[context][mixed]

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """Disjoint intervals [begin, end) of secret values, in order; a private key's begins at its BEGIN line."""
        if not text:
            return []
        out: list[tuple[int, int]] = []
        if any(x in text for x in _FORMAT_STARTS):
            for m in FORMATS.finditer(text):
                v = m[0]
                if len(set(v)) >= 8 and text[m.end() : m.end() + 1] not in ("/", "+") and self.secret(v, "format"):
                    out.append(m.span())
        if "PRIVATE KEY" in text:
            for m in PEM.finditer(text):
                body = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", m[1])
                if len(set(body)) >= 12 and self.secret(body, "block"):
                    out.append((m.start(), m.end(1)))
        if "://" in text:
            for m in URL.finditer(text):
                if not re.search(r"[{}<>$]|%\(|\*\*", m[2]) and (not m[2].isdigit() or m[1]) and self.secret(m[2], "url"):
                    out.append(m.span(2))
        low = text.lower()
        if len(low) != len(text):  # a few letters become two
            low = "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))
        if "bearer" in low or "basic" in low or "token" in low:
            for m in HEADER.finditer(text):
                if self._header(m):
                    out.append(m.span(2))
        line, named = -1, 0
        for h in HINT.finditer(low):
            at = h.start()
            if at >= named:  # one name holds several hints at times
                begin = at
                while begin > named and (text[begin - 1].isalnum() or text[begin - 1] in "_-"):
                    begin -= 1
                named = _NAME.match(text, at).end()
                m = VALUE.match(text, named)
                if m:
                    if self._assigned(low[begin:named], m[3]):
                        parts = [m.span(3)]
                        while m[1] and (more := _MORE.match(text, parts[-1][1] + 1)):  # a literal in parts
                            parts.append(more.span(2))
                        widths = {b - a for a, b in parts[:-1]}
                        if not (len(parts) > 2 and len(widths) == 1 and 60 <= min(widths) <= 80):
                            out.append((parts[0][0], parts[-1][1]))
                    continue
            elif VALUE.match(text, named):
                continue
            begin = text.rfind("\n", 0, at) + 1 if line < 0 or text.find("\n", line, at) >= 0 else line
            if begin != line:
                line = begin
                m = BARE.match(text, begin)
                if m and self._bare(m):
                    out.append(m.span(2))
                    continue
            m = INSIDE.match(text, at)
            if m and not text[at - 1 : at].isalnum() and self._in_literal(text[line:at]) and self.secret(m[1], "reference" if _REFERENCE.match(m[1]) and m[1].endswith("(") else "password"):
                out.append(m.span(1))
            for pattern, group in ((PROSE, 1), (PAIR, 2)):
                m = pattern.match(text, at)
                if m and not text[at - 1 : at].isalnum() and self._in_comment(text[line:at]) and self.secret(m[group], "prose"):
                    out.append(m.span(group))
        out.sort(key=lambda s: (s[0], -s[1]))
        kept: list[tuple[int, int]] = []
        for a, b in out:
            if kept and a < kept[-1][1]:
                kept[-1] = (kept[-1][0], max(b, kept[-1][1]))
            else:
                kept.append((a, b))
        return kept

    def _header(self, m: re.Match) -> bool:
        kind, v = m[1].lower(), m[2]
        if kind == "basic":
            try:
                plain = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode()
            except ValueError:
                return False
            return ":" in plain and plain.isprintable() and self.secret(plain.split(":", 1)[1], "url")
        return (len(v) >= 16 or kind == "bearer") and self.secret(v, "header") and any(map(str.isdigit, v))

    def _assigned(self, name: str, value: str) -> bool:
        if _NOT_A_SECRET.search(name):
            return False
        if _PASSWORD_NAME.search(name):
            return self.secret(value, "password")
        if _TOKEN_NAME.search(name):
            return self.secret(value, "token")
        return not _UUID.match(value) and not re.fullmatch(r"[0-9a-f]+", value) and self.secret(value, "key")

    def _bare(self, m: re.Match) -> bool:
        """A value without quotes is code more often than not, but for lines of settings: NAME=value."""
        name, v = m[1].lower(), m[2]
        if _NOT_A_SECRET.search(name):
            return False
        if _REFERENCE.fullmatch(v) and not (m[1].isupper() and m[0].rstrip().endswith(f"{m[1]}={v}")):
            return self.secret(v, "reference")
        return self.secret(v, "password" if "pass" in name or "pwd" in name else "token")

    @staticmethod
    def _in_comment(line: str) -> bool:
        return bool(re.search(r"(?:^|\s)(?:#|//|\*|--|;)|<!--|\"\"\"|'''", line))

    @staticmethod
    def _in_literal(line: str) -> bool:
        return line.count('"') % 2 == 1 or line.count("'") % 2 == 1 or bool(re.match(r"\s*(?:#|//)", line))


_MASK = re.compile(r"-----[A-Z0-9 ]+-----|\\.|[^\W_]")


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with letters and digits inside the spans replaced one for one by x; escapes and marks stay."""
    parts, at = [], 0
    for a, b in spans:
        parts += [text[at:a], _MASK.sub(lambda m: m[0] if len(m[0]) > 1 else "x", text[a:b])]
        at = b
    return "".join(parts) + text[at:]


@functools.lru_cache(maxsize=2)
def finder(path: str) -> Finder:
    return Finder(path)


def secret_lines(df: DataFrame, src: str, id_col: str, text_col: str = "content", path: str | None = None) -> DataFrame:
    """(src, row_id, line_no): the lines on which a secret begins; one narrow pass."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(path)
        for batch in batches:
            at, lines = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n in sorted({text.count("\n", 0, a) + 1 for a, _ in f.find(text)}):
                    at.append(i)
                    lines.append(n)
            yield pa.RecordBatch.from_arrays([pa.array([src] * len(at), pa.string()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(lines, pa.int32())], ["src", "row_id", "line_no"])

    return df.select(F.col(id_col).cast("long").alias("row_id"), text_col).mapInArrow(run, "src string, row_id long, line_no int")


def redacted(df: DataFrame, src: str, id_col: str, text_col: str = "content", path: str | None = None) -> DataFrame:
    """(src, row_id, secrets, content) of the rows that hold secrets, each masked."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(path)
        for batch in batches:
            at, counts, texts = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                spans = f.find(text)
                if spans:
                    at.append(i)
                    counts.append(len(spans))
                    texts.append(mask(text, spans))
            yield pa.RecordBatch.from_arrays([pa.array([src] * len(at), pa.string()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(counts, pa.int32()), pa.array(texts, pa.string())], ["src", "row_id", "secrets", "content"])

    return df.select(F.col(id_col).cast("long").alias("row_id"), text_col).mapInArrow(run, "src string, row_id long, secrets int, content string")
