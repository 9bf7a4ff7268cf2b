"""Problem 2: generated, minified, third-party and data files among source code.

What a file states of itself decides at once: a notice of a tool or of another project in its comments, and a directory for
third-party code. Every other file is judged by a random forest alone. Its features (compression ratio, token entropy,
identifier lengths, comment density and the like) are taken from the body without head and foot comments, and its labels
come from those comments only: notices of tools and banners of packers are one class, notices of an author or of the own
project the other. No feature takes part in a label.

Notices are rare in some forms (packed programs, tables of data), so the first class is filled up with background points,
as forests for unlabelled data do it: each feature of a point is drawn by itself, half from the marginal distribution over
labelled rows, half from the whole range over all rows. The forest thus encloses what hand-written files look like and
marks what lies outside. A file that it marks is no case if it is a page of another language (markup, C, shell), which is
checked on its first line.

Notices are read in all comments that begin at column 0 outside strings, and in the first docstring. Features and notices
are computed for every row; the forest is fitted on at most ``SAMPLE`` labelled rows of each class, taken by hash, and its
trees (a few KB) go to the executors.

Defined results: other languages, null contents and contents under ``TINY`` characters are no cases; a null repository
is no project, so a statement of belonging to a named one makes the file third-party; without rows of both labels there is
no forest, and notices alone decide."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut

TINY = 100
SAMPLE = 8000
#: From this score on the forest marks a file.
SURE = 0.84
TREES, DEPTH, CUTS, SEED = 96, 8, 32, 11
#: Background points a row of the first class in the sample; a fixed ratio keeps scores alike at every size.
BACKGROUND = 2.0
FEATURES = ("compression", "token_entropy", "char_entropy", "identifier_length", "short_identifiers", "comment_density", "line_length", "longest_line", "digits", "marks", "spaces", "distinct_tokens", "repeated_shape", "literals", "keywords", "statements_a_line")

#: Directories for third-party code (fixed values).
VENDOR_DIRS = re.compile(r"(?i)(?:^|/)(?:_?vendor(?:s|ed|_libs?)?|third[_-]?party|3rd[_-]?party|externals?|extern|extlibs?|node_modules|bower_components|jspm_packages|site-packages|dist-packages|deps|pods|carthage|godeps|thirdparty|wheels?-unpacked)/")
_TOOL = re.compile(
    r"(?i)@generated\b|\bauto-?generated (?:by|with|from|using|file|code)|\b(?:code|file|source|parser|module|client|bindings?|stubs?|class) (?:is |was |has been )?(?:auto-?|automatically |machine |programmatically )?(?:generated|created|produced|written|emitted|made) (?:by|with|from|using)\b"
    r"|^(?:this (?:file|code|module) (?:is|was|has been) )?(?:auto-?|automatically |machine |programmatically )?(?:generated|produced|created|emitted) (?:by|with|from|using|automatically|on)\b|^(?:auto-?generated|machine[- ](?:made|generated|written))\b|\bmachine[- ](?:made|generated|written) (?:by|from|with)"
    r"|\bdo not edit\b.{0,12}$|\bdo not edit (?:this|the) (?:file|class|code|module)|\bdo not (?:modify|change) (?:this file|by hand)|\bchanges (?:made )?(?:in|to) this file will be (?:lost|overwritten)|\bedits? will be (?:lost|overwritten)|\bhands off\b|\brerun `|\bform implementation (?:generated|written)"
    r"|\b(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|\bnicht (?:von hand )?(?:ändern|bearbeiten|editieren)|\b(?:fichier|code) (?:produit|généré|créé)|\bne pas (?:modifier|éditer)|\b(?:archivo|código|fichero) (?:generado|creado)|\bgenerado (?:por|automáticamente|con)|\bno (?:editar|modificar)\b|\b(?:file|codice) generato|\bnon modificare|\b(?:arquivo|código) gerado|\bnão edit|автоматически (?:создан|сгенерирован)|не редактировать|自动生成|自動生成|\bgenerated (?:by|from) .+ (?:compiler|codegen|generator)|\bproduced by:|\boutput of .+(?:compiler|codegen|generator)"
)
_NOT_TOOL = re.compile(r"(?i)hand[- ]?written|written by hand|\b(?:not|never|no longer) (?:auto-?)?(?:generated|created|produced)")
_THIRD = [
    re.compile(p)
    for p in (
        r"(?i)this (?:file|module|code) is part of (?:the )?([\w.-]+)",
        r"(?i)^([\w.-]+) -- part of (?:the )?([\w.-]+)",
        r"(?i)vendored (?:copy )?(?:from|of) ([\w./-]+)",
        r"(?i)^([\w.-]+) v?\d[\w.]* ?-+ ?(?:bundled|vendored|local|unmodified) copy",
        r"(?i)(?:taken|copied|imported|borrowed|adapted)(?: unchanged| verbatim| unmodified)? from (?:the )?([\w-]+)(?:==| \(| v?\d| package| project| library)",
        r"(?i)original source: (?:the )?([\w.-]+)",
        r"(?i)maintained by the ([\w.-]+) (?:project|authors|team|developers)",
        r"(?i)copyright (?:\(c\) ?|© ?)?[\d, -]+ ?(?:the )?([\w-]+) (?:authors|developers|project|team)\b",
        r"(?i)(?:bundled|shipped|distributed) (?:copy|version) of ([\w.-]+)",
        r"(?i)upstream(?: at|:) https?://(?:github\.com/[\w.-]+/)?([\w-]+)",
        r"(?i)(?:from|part of) the ([\w-]+) (?:project|library|package)\b",
    )
]
_ANYONE = {"the", "some", "any", "another", "other", "one", "here", "there", "contributors", "contributor", "original", "respective", "its", "this", "that", "project", "a", "an", "all", "our", "various", "python", "javascript"}
_HAND = re.compile(r"(?i)copyright|licen[cs]e|hand[- ]?written|\(c\)|see copying|contributors")
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\w\s]")
_KEYWORDS = frozenset("def class return if elif else for while import from with as assert try except raise pass break continue lambda yield async await del not and or in is None True False self const let var function new this typeof null true false case match switch".split())
_SHAPE = re.compile(r"\w+")
#: First lines of pages in other languages (fixed values).
_FOREIGN = re.compile(r"\s*(?:<(?:!doctype|html|head|body|svg|\?xml|\?php)\b|<!--|#\s*include\s*[<\"]|#!\S*\b(?:ba|da|z|k)?sh\b)", re.I)
_STRINGS = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|`(?:[^`\\]|\\.)*`", re.S)
_COMMENTS = re.compile(r"^(?:(?:#|//)[^\n]*|/\*.*?\*/)", re.S | re.M)
_BANNER = re.compile(r"\.min\.js\Z")


def _name(x: str) -> str:
    return re.sub(r"[^a-z0-9]", "", x.lower())


def _parts(text: str) -> tuple[list[str], str]:
    """(lines of head and foot comments and of the first docstring, without marks; the body without them)."""
    lines = text.replace("\r\n", "\n").split("\n")
    notes: list[str] = []
    i, n, quote = 0, len(lines), ""
    while i < n:
        s = lines[i].strip()
        if quote:
            notes.append(s.replace(quote, ""))
            if quote in s:
                quote = ""
        elif s.startswith(('"""', "'''", 'r"""')):
            quote = s.lstrip("r")[:3]
            notes.append(s.lstrip("r")[3:].replace(quote, ""))
            if s.count(quote) > 1:
                quote = ""
        elif s.startswith("/*"):
            notes.append(s)
            if "*/" not in s:
                quote = "*/"
            elif not s.endswith("*/"):
                break
        elif s.startswith(("#", "//", "<!--")) or not s:
            notes.append(s)
        else:
            break
        i += 1
    j = n
    while j > i:
        s = lines[j - 1].strip()
        if s and not s.startswith(("#", "//")):
            break
        notes.append(s)
        j -= 1
    body = "\n".join(lines[i:j])
    # Notices can also stand further down.
    if "\n#" in body or "\n/" in body:
        for c in _COMMENTS.findall(_STRINGS.sub("", body)):
            notes += c.split("\n")
    return [x.strip("#/*!<>- \t") for x in notes if x], body


def notice(text: str, repo: str | None, notes: list[str]) -> str:
    """tool, third, own, hand or '' by what the comments of head and foot state."""
    owner = {_name(x) for x in (repo or "").split("/")} | {_name(repo or "")}
    found = ""
    for line in notes:
        if _TOOL.search(line) and not _NOT_TOOL.search(line):
            return "tool"
        for pattern in _THIRD:
            m = pattern.search(line)
            if m:
                name = _name(m[m.lastindex].split("/")[-1])
                if name and name not in _ANYONE:
                    if name in owner or any(name and o and (o.startswith(name) or name.startswith(o)) and min(len(o), len(name)) >= 4 for o in owner):
                        found = found or "own"
                    else:
                        found = "third"
                    break
        if not found and _HAND.search(line):
            found = "hand"
    return found


def _entropy(counts) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts) if n else 0.0


def features(body: str) -> list[float]:
    raw = body.encode("utf-8", "replace")
    lines = [x for x in body.split("\n") if x.strip()]
    n, size = max(1, len(lines)), max(1, len(body))
    tokens = _TOKEN.findall(body)
    counts = Counter(tokens)
    names = [t for t in counts if (t[0].isalpha() or t[0] == "_") and t not in _KEYWORDS]
    uses = sum(counts[t] for t in names) or 1
    longs = [len(x) for x in lines] or [0]
    shapes = Counter(x for x in _SHAPE.sub("w", body).split("\n") if x.strip())
    top = sum(c for _, c in shapes.most_common(3)) / n if lines else 0.0
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    digits, letters = int(chars[48:58].sum()), int(chars[65:91].sum() + chars[97:123].sum() + chars[95] + chars[128:].sum())
    spaces = int(chars[32] + chars[9] + chars[10] + chars[13])
    share = chars[chars > 0] / max(1, len(raw))
    total = max(1, len(raw))
    comments = sum(1 for x in lines if x.lstrip()[:1] == "#" or x.lstrip()[:2] in ("//", "/*"))
    return [
        len(zlib.compress(raw, 1)) / total,
        _entropy(counts.values()),
        float(-(share * np.log2(share)).sum()),
        sum(len(t) * counts[t] for t in names) / uses,
        sum(counts[t] for t in names if len(t) <= 2) / uses,
        comments / n,
        size / n,
        math.log1p(max(longs)),
        digits / total,
        (total - digits - letters - spaces) / total,
        spaces / total,
        len(counts) / max(1, len(tokens)),
        top,
        literal_share(body),
        sum(v for t, v in counts.items() if t in _KEYWORDS) / max(1, len(tokens)),
        body.count(";") / n,
    ]


_LITERAL = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<![\w.])-?\d[\w.]*", re.S)


def literal_share(body: str) -> float:
    """Share of the characters other than white space and list marks that stand in literals."""
    solid = len(body) - body.count(" ") - body.count("\n") - body.count(",")
    inside = 0
    for x in _LITERAL.findall(body):
        inside += len(x) - x.count(" ") - x.count("\n") - x.count(",")
    return min(1.0, inside / max(1, solid))


class Forest:
    """A random forest of binary trees over quantile-cut features, kept as arrays."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> "Forest":
        rng = np.random.default_rng(seed)
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        out = []
        for _ in range(trees):
            rows = rng.choice(n, n, replace=True)
            feature, cut_at, leaf = np.full(2 ** (depth + 1), -1), np.zeros(2 ** (depth + 1)), np.full(2 ** (depth + 1), 0.5)
            queue = [(1, rows)]
            while queue:
                node, at = queue.pop()
                w, pos = weight[at], weight[at] * y[at]
                leaf[node] = pos.sum() / max(1e-12, w.sum())
                if node >= 2**depth or len(at) < 8 or leaf[node] in (0.0, 1.0):
                    continue
                best = (1e-9, -1, 0)
                whole = w.sum() * leaf[node] * (1 - leaf[node])
                for j in rng.choice(d, max(2, int(math.sqrt(d))), replace=False):
                    k = len(edges[j]) + 1
                    a = np.cumsum(np.bincount(binned[at, j], w, k))[:-1]
                    p = np.cumsum(np.bincount(binned[at, j], pos, k))[:-1]
                    b, q = w.sum() - a, pos.sum() - p
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = whole - np.nan_to_num(p * (a - p) / a) - np.nan_to_num(q * (b - q) / b)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
                if best[1] >= 0:
                    j, c = best[1], best[2]
                    feature[node], cut_at[node] = j, edges[j][c]
                    left = binned[at, j] <= c
                    queue += [(2 * node, at[left]), (2 * node + 1, at[~left])]
            out.append((feature, cut_at, leaf))
        return cls(out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut_at, leaf in self.trees:
            node = np.ones(len(x), int)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f, 0)] > cut_at[node]
                node = np.where(inner, 2 * node + go, node)
            total += leaf[node]
        return total / max(1, len(self.trees))


_SCHEMA = "id long, notice string, vendored boolean, strange boolean, label int, " + ", ".join(f"f{i} float" for i in range(len(FEATURES)))


def described(df: DataFrame, id_col: str, text_col: str, repo_col: str, path_col: str) -> DataFrame:
    """Notice, third-party directory, page of another language, label (1 by notice of a tool or banner of a packer, 0 by
    notice of an author or the own project, else null) and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, repo, path in zip(*(c.to_pylist() for c in batch.columns)):
                if i is None or text is None or len(text) < TINY or not text.strip():
                    continue
                notes, body = _parts(text)
                what = notice(text, repo, notes)
                banner = text.startswith("/*!") or bool(_BANNER.search(path or ""))
                label = 1 if what == "tool" or banner and what != "third" else 0 if what in ("own", "hand") else None
                rows.append((i, what, bool(VENDOR_DIRS.search(path or "")), bool(_FOREIGN.match(text)), label, features(body)))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int32()))]
            x = np.array([r[5] for r in rows], np.float32).reshape(len(rows), len(FEATURES))
            yield pa.RecordBatch.from_arrays(cols + [pa.array(x[:, k]) for k in range(len(FEATURES))], ["id", "notice", "vendored", "strange", "label", *[f"f{k}" for k in range(len(FEATURES))]])

    return df.select(F.col(id_col).cast("long"), text_col, repo_col, path_col).mapInArrow(run, _SCHEMA)


def background(x: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Points whose features are drawn each by itself: half from the rows of x, half from the range."""
    rng = np.random.default_rng(seed)
    drawn = np.stack([x[rng.integers(0, len(x), n), j] for j in range(x.shape[1])], axis=1)
    return np.where(rng.random(drawn.shape) < 0.5, low + (high - low) * rng.random(drawn.shape), drawn)


def fit_forest(rows: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """A forest over at most sample rows of each label, taken by the hash of their ids, and background points within the
    ranges of all rows."""
    names = [f"f{k}" for k in range(len(FEATURES))]
    ends = rows.agg(*[f(n) for n in names for f in (F.min, F.max)], *[F.count(F.when(F.col("label") == k, 1)) for k in (0, 1)]).first()  # one row
    counts = dict(enumerate(ends[-2:]))
    if not all(counts.values()):
        return None
    parts = []
    for label, n in counts.items():
        share = min(1.0, 0.95 * sample / n)
        parts.append(rows.filter((F.col("label") == label) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))).limit(sample))
    got = parts[0].unionByName(parts[1]).select("id", "label", *names).toPandas().sort_values(["id", *names])
    x, y = got[names].to_numpy(np.float64), got["label"].to_numpy(np.int64)
    more = background(x, np.array(ends[: 2 * len(names) : 2], float), np.array(ends[1 : 2 * len(names) : 2], float), int(BACKGROUND * y.sum()))
    return Forest.fit(np.concatenate((x, more)), np.concatenate((y, np.ones(len(more), np.int64))))


def verdicts(df: DataFrame, id_col: str = "seq", text_col: str = "content", repo_col: str = "max_stars_repo_name", path_col: str = "max_stars_repo_path") -> DataFrame:
    """(id, reason, score) of every row that is not hand-written source of its repository; reason is tool, third or vendored
    by statement, else data, packed or generated by what stands out in a file that the forest marks."""
    rows = cut(described(df, id_col, text_col, repo_col, path_col), "origin")
    shared = df.sparkSession.sparkContext.broadcast(fit_forest(rows))
    literals, width = FEATURES.index("literals"), FEATURES.index("line_length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            x = np.stack([batch.column(5 + k).to_numpy() for k in range(len(FEATURES))], axis=1).astype(np.float64)
            score = forest.predict(x) if forest and len(x) else np.zeros(len(x))
            said = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))
            marked = np.where(x[:, width] > 200, "packed", np.where(x[:, literals] > 0.5, "data", "generated"))
            reasons = [what if what in ("tool", "third") else "vendored" if vendored else m if s >= SURE and not strange else None for (what, vendored, strange), s, m in zip(said, score, marked.tolist())]
            keep = pa.array([k for k, r in enumerate(reasons) if r], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), pa.array([r for r in reasons if r], pa.string()), pa.array(score).take(keep)], ["id", "reason", "score"])

    return rows.mapInArrow(run, "id long, reason string, score double")
