"""Problem 9: sentence boundaries across languages and scripts.

A text is cut into blocks, lines and list items first (code, headings and marks are units by their layout). What remains
is prose. The terminators of a stretch form a lattice: each is a node, a path through the nodes is a segmentation, and its
cost comes from the words on both sides of each node and from what a unit must hold; the cheapest path is taken.

Scripts without spaces (Chinese, Japanese, Thai) are segmented into words first: the dictionary is the part of a public
vocabulary that is written in the script, with the closed lists of particles, connectives and openers below; every run of
letters is a lattice of its words, a word costs what its rank says, and the cheapest path gives the words on both sides of a
gap. A final particle before and an opening word after speak for an end, a word that goes on with the sentence against
it; see ``_gap_cost``. They are set against the mark, by what it says alone (``_MARK_COSTS``): an ellipsis gives way to a
connective unless a final particle stands before it, an exclamation or question mark to words that open no sentence, a full
stop to case particles without a final particle before it; behind a quotation the word after decides, and a title or a
bracket within a sentence ends it only before an opening word. A space between two Thai letters is an end by definition, so
no words are asked there. Korean, Hindi and Arabic are spaced; there only the word after a quotation is looked up.

Quotations, brackets and code spans are found as pairs beforehand; a terminator inside one ends nothing unless the pair
closes right after it and nothing goes on.

Defined results: null, empty and blank texts have no units; a pair that never closes is ordinary text; a fence without an
end runs to the end of the text; positions count code points of the text as it is."""

from __future__ import annotations

import base64
import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.encode import vocabulary

# Abbreviations that stand before what they belong to: their dot never ends a sentence (fixed values, several languages).
LEADING = frozenset(
    """dr prof ms mr mrs messrs st mt no nos nr fig figs sec secs ch chap vol pp p art eq ref refs ed eds vs viz cf e.g i.e eg ie approx ca resp incl excl abs
    abschn kap bd bzw vgl sog ggf evtl inkl exkl zzgl geb hrsg str tel frl hr fr dipl ing nat med phil z.b d.h u.a o.ä s.o s.u i.d.r
    m mm mme mmes mlle env c.-à-d càd av boul ex réf chap tél
    sr sra srta dra dres pág págs aprox núm cap art ej p.ej ee ud uds vd av dpto
    см рис табл гл стр ок акад проф им ул тел напр т.е др-р г-н
    sig sig.ra dott pag ecc.. cap tav sen gen col sgt capt lt cmdr gov rep rev hon
    डॉ श्री प्रो سم د أ م""".split()
)
# Abbreviations that may end a sentence (fixed values).
TRAILING = frozenset("etc usw u.s u.k u.n e.u a.m p.m ff inc ltd co corp jr sr. ph.d b.c a.d et.al al dgl uu ee.uu т.д т.п др пр гг вв ecc ss jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun".split())
_MONTHS_SHORT = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec".split())
# Words after a German ordinal number (fixed values).
_AFTER_ORDINAL = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Auflage Kapitel Abschnitt Jahrhundert Ausgabe Version Teil Band Absatz Stock Platz Tag Woche Mal Schritt Zeile Lauf".split())
_BEFORE_ORDINAL = frozenset("am der die das dem den des zum zur im vom bis ab seit jeder jede jedes".split())
# German words that open a sentence rather than follow an ordinal (fixed values).
_DE_OPENERS = frozenset("Der Die Das Am Im Siehe Warum Danach Prof Dr Wenn Ein Eine Es Er Sie Wir Ich Und Aber Dann Hier Man Bei Mit Nach Vor Für Wie Was Wer Wo".split())
# Lower-case words that go on with a sentence and open none (fixed values).
_GOING_ON = frozenset("then and but or which that who when while if unless until because since so as than though although where to of in on at by for with from after before every far also office says said wrote builds is are was were the a an".split())

_TERMINATORS = ".!?…。！？｡।॥؟۔"
# Pairs of which the next mark of the family after the one that opens must be one that closes; round brackets also nest.
_CLOSED_BY = {"`": ("`\n", "`"), '"': ('"', '"'), "„": ("“”„", "“”"), "“": ("“”", "”"), **{x[0]: (x, x[1]) for x in ("«»", "‹›", "「」", "『』", "《》", "（）", "[]", "【】")}}
_PAIR_MARKS = re.compile("[`\\n\"„“”«»‹›「」『』《》()（）\\[\\]【】]")
_CLOSERS = "\"'”“’»›」』》)）]】"
_STOP = re.compile(r"(?:[.!?…]+[\"'”“’»›)\]]*(?=\s|\Z)|[。！？｡।॥؟۔…]+[!?！？。…]*[\"”’»」』》)）\]】]*)")
_THAI = re.compile(r"(?<=[ก-ฺเ-๛])(?:[^\S\n][^\S\n]*)(?=[ก-ฺเ-๛])")
_WORD_BEFORE = re.compile(r"([^\s\"“„«»”()（）\[\]]+)\Z")
_CODE = re.compile(r"`|[A-Za-z_][\w./-]*(?:[_./(]|\(\))[\w./()-]*|[a-z][a-z0-9]*\.[a-z_]|[a-z]+[A-Z]\w*|[a-z]+\d\w*|<\||[\w./-]+\.(?:py|js|toml|cfg|json|gz|txt|md|rst|ini|yaml|yml|sh|c|h)\b")
_PLURAL = re.compile(r"([a-z]+)(?: [a-z]+)?s (?:fail|break|need|use|have|do|can|must|should|hold|keep|run|stop|work|start|raise|return|live|come|go|stay|map)\b")
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ฀-๿]")

# Words of scripts without spaces that matter at a gap (fixed values): what goes on with a sentence after a quotation or bracket, and what opens one.
_ON = {
    "zh": "但是 但 然而 而 并且 并 的 地 得 再 则 也 就 却 都 是 这样 这么 如此 说 写道 认为 和 与 或 及 之 中 里 后 前 时 等".split(),
    "ja": "という といった とは との とも として と って が を は に の で も や へ から まで より など だ です である でも なら ので のに ため".split(),
    "ko": "이라고 라고 라는 이라는 하고 고 며 면서 라며 는 은 이 가 을 를 에 의 로 으로 와 과 도".split(),
    "hi": "ऐसा ऐसे इस यह कह कहा कहता कहती कहते कि और में के की का को से ने पर तो भी".split(),
    "ar": "هكذا قال يقول تقول قالت كما كتب وقال ثم و أو لكن ولكن بل حيث".split(),
}
_OPEN = {
    "zh": "这个 这些 这 那个 那些 那 从 请 参见 为什么 如果 他说 她说 他 她 它 我们 我 你 先 结果 说明 当 因为 所以 由于 在 每个 一个 首先 然后 最后 不要".split(),
    "ja": "この その あの これ それ 最初 まだ 詳しく なぜ もし しかし そして また ここ 次 例えば ただし 彼 彼女 私 すべて".split(),
}
# Words that close a sentence in scripts without spaces (fixed values).
_FINAL = {
    "zh": "了 吗 呢 吧 啊 呀 嘛 啦 么 的 过 好 完 真的 而已 罢了".split(),
    "ja": "です ます でした ました ません だ だった た ない か ね よ な ください でしょう ましょう だろう".split(),
    "th": "ครับ ค่ะ คะ นะ จ้ะ จ๊ะ แล้ว มาก เสมอ เลย ไหม หรือ ด้วย อีก".split(),
}
_ON["th"] = "ที่ ซึ่ง และ แต่ เพราะ โดย ว่า ของ".split()
_OPEN["th"] = "เมื่อ ตั้งแต่ โปรด อย่า ทำไม ถ้า หาก ผม ฉัน เขา เรา นี่ ดังนั้น ที่นี่ ที่นั่น แต่ละ".split()
# Of the words that go on those that open no sentence, and what they cost before a letter that begins another word (fixed
# values): quotatives outweigh all marks but a full stop, case particles that as well.
_BOUND = {
    "zh": {"的": 2.7, "的话": 2.7, "之类": 2.7, "之一": 2.7, "似的": 2.7},
    "ja": {**dict.fromkeys("と って とは".split(), 2.7), **dict.fromkeys("という といった との として を は に の も へ".split(), 3.2)},
    "th": {"ซึ่ง": 2.7},
}
for _s, _w in _BOUND.items():
    _ON[_s] += [w for w in _w if w not in _ON[_s]]
# Words that begin like one that goes on and are none (fixed values).
_WHOLE = {"zh": "的确 的士 的哥 也许 就算 都市 后来 前天 再见 再次 和平 和谐 时间 时候 地方 地图 地址 得到 等待 说话 中午 与其 或许 及时".split()}
_FUNCTION = {s: {**{w: "final" for w in _FINAL.get(s, ())}, **{w: "on" for w in _ON.get(s, ())}, **{w: "open" for w in _OPEN.get(s, ())}} for s in _ON}
_CLOSES = {s: frozenset(w) for s, w in _FINAL.items()}
# Ends of longer words of the vocabulary that close a sentence as well, and words that only look so (fixed values).
_TAILS = {"zh": tuple("了 吗 呢 吧 啊 呀 嘛 啦".split()), "ja": tuple("です ます でした ました ません った ください でしょう ましょう だろう ですか ますか ませんか ましたか でしたか".split())}
_NO_TAILS = frozenset("为了 除了".split())
_HAN, _KANA, _THAI_LETTER = "㐀-鿿豈-﫿", "぀-ヿｦ-ﾟ", "ก-ฺเ-๎"
#: A run of letters of scripts without spaces.
_RUN = re.compile(f"[{_HAN}{_KANA}{_THAI_LETTER}]+")
_IN_SCRIPT = {"zh": re.compile(f"[{_HAN}]+\\Z"), "ja": re.compile(f"[{_HAN}{_KANA}]+\\Z"), "th": re.compile(f"[{_THAI_LETTER}]+\\Z")}
#: What a character outside the dictionary and a function word cost, in bits; the words of the vocabulary cost the logarithm of their rank.
_UNKNOWN, _KNOWN = 20.0, 8.0
#: Characters of a spaced word among which a function word is looked for.
_LONGEST_WORD = 8
_SPACED_WORD = re.compile(r"\S*")


class WordLattice:
    """The words of one script and the cheapest paths through the lattices of its runs; paths are kept, up to a bound."""

    def __init__(self, script: str, path: str | None = None):
        self.costs: dict[str, float] = {}
        self.paths: dict[str, list[str]] = {}
        if script in _IN_SCRIPT and path:
            with open(path, "rb") as f:
                for line in f:
                    token, rank = line.split()
                    word = base64.b64decode(token).decode("utf-8", "replace").strip()
                    if word and _IN_SCRIPT[script].match(word):
                        self.costs[word] = min(self.costs.get(word, _UNKNOWN), math.log2(int(rank) + 2))
        for word in [*_FUNCTION[script], *_WHOLE.get(script, ())]:
            self.costs[word] = min(self.costs.get(word, _UNKNOWN), _KNOWN)
        self.longest = max(map(len, self.costs), default=1)

    def words(self, run: str) -> list[str]:
        got = self.paths.get(run)
        if got is None:
            n, costs, longest = len(run), self.costs, self.longest
            # Words begin and end between characters with their marks.
            places = [i for i in range(n) if unicodedata.category(run[i]) != "Mn" or not i] + [n]
            best, back = {0: 0.0}, {}
            for k in range(1, len(places)):
                j, i = places[k], places[k - 1]
                best[j], back[j] = best[i] + costs.get(run[i:j], _UNKNOWN), i
                h = k - 2
                while h >= 0 and j - places[h] <= longest:
                    i = places[h]
                    c = costs.get(run[i:j])
                    if c is not None and best[i] + c < best[j]:
                        best[j], back[j] = best[i] + c, i
                    h -= 1
            got, j = [], n
            while j > 0:
                got.append(run[back[j] : j])
                j = back[j]
            got.reverse()
            if len(self.paths) > 20_000:
                self.paths.clear()
            if n <= 200:
                self.paths[run] = got
        return got


@functools.lru_cache(maxsize=None)
def lattice(script: str, path: str | None = None) -> WordLattice:
    return WordLattice(script, path or multilingual())


def multilingual() -> str:
    """The public vocabulary whose words are the dictionary."""
    return vocabulary("byte_bpe_multi_50k")


def _script(ch: str) -> str:
    o = ord(ch)
    if 0x3040 <= o <= 0x30FF or 0xFF66 <= o <= 0xFF9F:
        return "ja"
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
        return "zh"
    if 0xAC00 <= o <= 0xD7A3 or 0x1100 <= o <= 0x11FF:
        return "ko"
    if 0x0900 <= o <= 0x097F:
        return "hi"
    if 0x0600 <= o <= 0x06FF or 0x0750 <= o <= 0x077F or 0xFB50 <= o <= 0xFEFC:
        return "ar"
    if 0x0E00 <= o <= 0x0E7F:
        return "th"
    return ""


def around(text: str, lo: int, stop: int, at: int, hi: int, script: str) -> tuple[str, str]:
    """(the last word before `stop`, the first word from `at` on) by the script's lattice over the whole runs of letters there."""
    if script not in _IN_SCRIPT:
        words = lattice(script).words(_SPACED_WORD.match(text, at, hi)[0][:_LONGEST_WORD])
        return "", words[0] if words else ""
    words = lattice(script)
    begin = stop
    while begin > lo and _RUN.match(text[begin - 1]):
        begin -= 1
    before = words.words(text[begin:stop]) if begin < stop else [""]
    m = _RUN.match(text, at, hi)
    after = words.words(m[0]) if m else [""]
    return before[-1], after[0]


#: What a mark costs by itself: a full stop, an exclamation or question mark, an ellipsis; a mark with which a quotation closes,
#: and one with which a title or a bracket within a sentence does.
_MARK_COSTS = {"stop": -3.0, "call": -2.0, "ellipsis": -1.2, "quoted": -0.4, "inner": 0.3}


def _gap_cost(base: float, script: str, before: str, after: str, bound: bool = False) -> float:
    """Cost of ending a unit between two words; below 0: likely an end. Final particles and openers speak for it, words
    that go on with the sentence against it, those that open no sentence (bound) more than others."""
    kind = _FUNCTION[script].get(after, "")
    on = _BOUND[script].get(after, 1.5) if bound and script in _BOUND else 1.5
    return base + (on if kind == "on" else -0.5 if kind == "open" else 0.0) - (0.6 if _closes(script, before) else 0.0)


def _closes(script: str, word: str) -> bool:
    return word in _CLOSES.get(script, ()) or word.endswith(_TAILS.get(script, ())) and word not in _NO_TAILS


def _mark(run: str) -> str:
    """The strongest mark of a run."""
    return "stop" if any(c in "。｡।॥۔" for c in run) else "call" if any(c in "!?！？؟" for c in run) else "ellipsis"


def _goes_into_a_word(text: str, at: int, hi: int) -> bool:
    """Whether another word begins at `at`; Hiragana may as well go on with the one before, a mark makes it a connective."""
    return at < hi and text[at].isalnum() and not "ぁ" <= text[at] <= "ゟ"


def _within(text: str, lo: int, at: int) -> bool:
    """Whether the bracket or title that opens at `at` stands in a sentence: a title always, a bracket unless one ends before it."""
    if text[at] == "《":
        return True
    if text[at] not in "([（【":
        return False
    while at > lo and (text[at - 1].isspace() or text[at - 1] in _CLOSERS):
        at -= 1
    return at > lo and text[at - 1] not in _TERMINATORS and text[at - 1] not in ":："


def _next_kind(text: str, at: int, end: int) -> str:
    """What stands from at on: end, upper, lower, opener, digit, quote, other or the script of a letter without case."""
    while at < end and (text[at].isspace() or text[at] in "​‌‍⁠﻿­"):
        at += 1
    if at >= end:
        return "end"
    c = text[at]
    if c in "\"'“„«‹「『《(（[【¿¡":
        return "quote"
    if c == "`":
        return "opener"
    script = _script(c)
    if script:
        return script
    if c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit():
        return "digit"
    if c in ",;:，、；：–—-/=+|":
        return "mark"
    if c.isalpha():
        if not c.islower():
            return "upper"
        m = _CODE.match(text, at, min(end, at + 80))
        if m:
            return "opener"
        m = _PLURAL.match(text, at, min(end, at + 60))
        if m and m[1] not in _GOING_ON:
            return "opener"
        return "lower"
    return "opener" if text.startswith("<|", at) else "other"


def _dot_cost(text: str, lo: int, stop: int, after: int, end: int, kind: str) -> float:
    """Cost of ending a unit at the single dot that begins at stop; below 0: likely an end."""
    m = _WORD_BEFORE.search(text, max(lo, stop - 40), stop)
    word = m[1] if m else ""
    bare = word.lower().lstrip("'’`*_-")
    last = bare.rsplit("/", 1)[-1]
    head = text[max(lo, stop - len(word) - 12) : stop - len(word)].rstrip() if word else ""
    if not word:
        return -1.0 if kind not in ("lower", "mark") else 1.0
    if last.replace(".", "").isdigit() and word.isascii():
        # numbers: ordinals go on, others end before whatever can open a sentence
        if kind == "upper" and last.isdigit() and len(last) <= 3:
            nxt = re.match(r"\s*([^\W\d_]+)", text[after : after + 40])
            before = re.search(r"([^\W\d_]+)\Z", head)
            if nxt and (nxt[1] in _AFTER_ORDINAL or before and before[1].lower() in _BEFORE_ORDINAL and nxt[1] not in _DE_OPENERS):
                return 1.0
        return 1.0 if kind in ("lower", "mark") else -1.0
    if last in TRAILING or last.strip(".") in ("u.s", "p.m", "a.m"):
        if last in _MONTHS_SHORT and kind == "digit":
            return 1.0
        return -0.5 if kind in ("upper", "opener", "quote", "end", "other") or kind in ("hi", "ar", "ko", "zh", "ja", "th") else 1.0
    if last in ("д", "п") and re.search(r"(?:^|\s)т\.\s*\Z", text[max(lo, stop - 8) : stop - len(word)]):
        return -0.5 if kind in ("upper", "opener", "quote", "end", "digit") else 1.0
    if last in LEADING:
        # no and m are also words; the words end sentences, the abbreviations stand before numbers and names
        if last == "no" and (word == "no" or kind != "digit"):
            return -1.0 if kind not in ("lower", "mark") else 1.0
        return 2.0
    letters = last.replace(".", "").replace("-", "")
    if len(letters) == 1 and letters.isalpha() or "." in last and all(len(x) <= 1 for x in last.split(".")):
        return 2.0  # initials and letters of spaced abbreviations
    if kind in ("lower", "mark"):
        return 1.0
    return -1.0


def _pairs(text: str, start: int, hi: int) -> list[tuple[int, int]]:
    """Disjoint spans of the outermost pairs in [start, hi), of any length, in order; a pair around nothing is none."""
    marks = [(m.start(), m[0]) for m in _PAIR_MARKS.finditer(text, start, hi)]
    closes: dict[int, int] = {}
    after: dict[str, int] = {}  # where each mark stands next
    depth: list[int] = []
    for at, c in reversed(marks):
        if c in _CLOSED_BY:
            family, closers = _CLOSED_BY[c]
            end = min((after[x] for x in family if x in after), default=-1)
            if end > at + 1 and text[end] in closers and not (c == '"' and text[at + 1].isspace()):
                closes[at] = end
        after[c] = at
    for at, c in marks:
        if c == "(":
            depth.append(at)
        elif c == ")" and depth:
            begin = depth.pop()
            if at > begin + 1:
                closes[begin] = at
    out, done = [], start
    for at, _ in marks:
        if at >= done and at in closes:
            done = closes[at] + 1
            out.append((at, done))
    return out


def _stretch(text: str, lo: int, hi: int, start: int) -> list[int]:
    """Ends of the sentences of the prose in [start, hi); lo is where its unit begins (a list mark may stand before start)."""
    nodes: list[tuple[int, float]] = []  # (end, cost)
    spans = _pairs(text, start, hi)
    k = 0
    for m in _STOP.finditer(text, start, hi):
        a, b = m.span()
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        inside = k < len(spans) and spans[k][0] < a < spans[k][1]
        quoted = False
        if inside:
            s, e = spans[k]
            if not (e <= b and text[s] != "`" or text[s] != "`" and text[b:e].strip() == ""):
                continue
            quoted, b = True, max(b, e)
            # an outer pair that closes here too belongs to the sentence
            while b < hi and text[b] in _CLOSERS and not text[b - 1].isspace():
                b += 1
        run = text[a:b].rstrip(_CLOSERS)
        kind = _next_kind(text, b, hi)
        if kind == "end":
            continue
        if kind == "mark" and (quoted or run[-1:] in ".…"):
            continue
        if kind in _ON:
            at = b
            while text[at].isspace():
                at += 1
            script = kind
            if kind == "zh" and re.search(r"[぀-ヿ]", text[max(lo, a - 30) : min(hi, b + 30)]):
                script = "ja"
            if quoted or script in _IN_SCRIPT and run != ".":
                before, after = around(text, lo, a, at, hi, script)
                mark = _mark(run)
                if quoted:
                    mark = "inner" if _within(text, start, spans[k][0]) else "quoted"
                    # What a title or bracket says does not close the sentence around it.
                    before = "" if mark == "inner" else before
                cost = _gap_cost(_MARK_COSTS[mark], script, before, after, _goes_into_a_word(text, at + len(after), hi))
                if quoted and cost >= 0:
                    continue
                if not quoted or text[a] in "!！?？" and script in ("zh", "ja") and text[b : b + 1] not in ("", " "):
                    nodes.append((b, cost))
                    continue
        if quoted:
            opener = text[spans[k][0]]
            if kind == "lower" or kind == "mark":
                continue
            if opener in "([（【" and kind not in ("upper", "opener", "quote", "zh", "ja"):
                continue
            if text[a] == "." and run == ".":
                nodes.append((b, max(-1.0, min(-0.3, _dot_cost(text, lo, a, b, hi, kind)))))
            else:
                nodes.append((b, -1.0))
            continue
        if run == ".":
            cost = _dot_cost(text, lo, a, b, hi, kind)
        elif set(run) <= {".", "…"}:
            cost = 1.0 if kind in ("lower", "mark") else -1.0
        elif run[0] in ".!?…":
            cost = 1.0 if kind == "lower" or kind == "mark" and run[-1] in ".…" else -1.0
        else:
            cost = 1.0 if kind == "mark" else -1.0
        if cost < 2.0:
            nodes.append((b, cost))
    if _THAI.search(text, start, hi):
        spans_at = 0
        for m in _THAI.finditer(text, start, hi):
            a = m.start()
            while spans_at < len(spans) and spans[spans_at][1] <= a:
                spans_at += 1
            if not (spans_at < len(spans) and spans[spans_at][0] < a < spans[spans_at][1]):
                # A space between two Thai letters is an end by definition, whatever the words.
                nodes.append((a, -2.0))
        nodes.sort()
    end = hi
    while end > lo and text[end - 1].isspace():
        end -= 1
    return _path(text, start, end, nodes)


def _path(text: str, start: int, end: int, nodes: list[tuple[int, float]]) -> list[int]:
    """The cheapest path from start to end; a unit without a letter or digit costs more than any node saves."""
    if not nodes:
        return [end] if end > start else []
    if all(c < 0 for _, c in nodes) and all(b - a > 3 for (a, _), (b, _) in zip([(start, 0), *nodes], nodes)):
        out = [b for b, _ in nodes if b < end]
        return [*out, end]
    points = [(start, 0.0), *[n for n in nodes if n[0] < end], (end, 0.0)]
    cost, back = [0.0] * len(points), [0] * len(points)
    # The cheapest earlier points, of equal ones the last: those with a letter or digit between them and j, and those without.
    far, near = -1, 0
    for j in range(1, len(points)):
        if any(map(str.isalnum, text[points[j - 1][0] : points[j][0]])):
            if far < 0 or near >= 0 and cost[near] <= cost[far]:
                far = near
            near = -1
        i, more = far, 0.0
        if near >= 0 and (far < 0 or cost[near] + 3.0 <= cost[far]):
            i, more = near, 3.0
        cost[j], back[j] = cost[i] + points[j][1] + more, i
        if near < 0 or cost[j] <= cost[near]:
            near = j
    out, j = [], len(points) - 1
    while j > 0:
        out.append(points[j][0])
        j = back[j]
    return out[::-1]


_HEADING = re.compile(r"#{1,6}(?:\s|\Z)")
_UNDERLINE = re.compile(r"(?:={2,}|-{2,}|~{3,}|\^{3,})\s*\Z")
_ITEM = re.compile(r" {0,3}(?:[-*•] |\d{1,9}\. )\s*")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def ends(text: str | None) -> list[int]:
    """End positions of the units of a text, in order."""
    if not text or text.isspace():
        return []
    out: list[int] = []
    lines: list[tuple[int, int, str]] = []  # of the current block: begin, end, text without what is blank at its end
    at = 0
    fence = ""
    fence_from = 0
    last_end = 0
    for raw in text.split("\n"):
        line = raw.rstrip()
        lo, hi = at, at + len(line)
        at += len(raw) + 1
        if fence:
            if line:
                last_end = hi
            if line.strip() and set(line.strip()) == {fence[0]} and len(line.strip()) >= len(fence):
                out.append(hi)
                fence = ""
            continue
        m = _FENCE.match(line)
        if m and "`" not in line[m.end() :]:
            if lines:
                out += _block(text, lines)
                lines = []
            fence, fence_from, last_end = m[1], lo, hi
            continue
        if line:
            lines.append((lo, hi, line))
        elif lines:
            out += _block(text, lines)
            lines = []
    if fence and last_end > fence_from:
        out.append(last_end)
    if lines:
        out += _block(text, lines)
    return out


def _block(text: str, lines: list[tuple[int, int, str]]) -> list[int]:
    first = lines[0][2]
    if first.lstrip().startswith(">>>") or all(x.startswith(("    ", "\t")) for _, _, x in lines):
        return [lines[-1][1]]
    out: list[int] = []
    begin = start = -1

    def flush(hi: int) -> None:
        nonlocal begin
        if begin >= 0:
            out.extend(_stretch(text, begin, hi, start))
        begin = -1

    i, n = 0, len(lines)
    while i < n:
        lo, hi, line = lines[i]
        if _HEADING.match(line):
            if begin >= 0:
                flush(lines[i - 1][1])
            out.append(hi)
        elif i + 1 < n and _UNDERLINE.match(lines[i + 1][2]) and not _ITEM.match(line):
            if begin >= 0:
                flush(lines[i - 1][1])
            out.append(lines[i + 1][1])
            i += 1
        else:
            m = _ITEM.match(line)
            if m:
                if begin >= 0:
                    flush(lines[i - 1][1])
                begin, start = lo, lo + m.end()
            elif begin < 0:
                begin = start = lo
            if line.endswith((":", "：")):
                flush(hi)
        i += 1
    if begin >= 0:
        flush(lines[-1][1])
    return out


def sentence_ends(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, end_pos INT): one row a unit; a narrow pass without a shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            found: list[int] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                e = ends(text)
                at += [i] * len(e)
                found += e
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int32())], [id_col, "end_pos"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, end_pos int")


def sentence_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, unit): the units themselves, numbered from 1."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, units = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                begin = 0
                for n, e in enumerate(ends(text), 1):
                    at.append(i)
                    numbers.append(n)
                    units.append(text[begin:e].strip())
                    begin = e
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(units, pa.string())], [id_col, "n", "unit"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n int, unit string")
