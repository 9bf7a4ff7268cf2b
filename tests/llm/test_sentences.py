import itertools
import random

import pytest

from quern.llm import sentences
from quern.llm.sentences import _path, around, ends, lattice, sentence_ends, sentence_units


def units(text):
    out, at = [], 0
    for e in ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


CASES = [
    ["It works.", "That is all…", "What happens if it raises?!", "Do not share one tuple!"],
    ["Dr. Zulogo and Prof. Morgolo wrote it in approx. 4 hours.", "J. R. Bivikel reported this.", "The first came from a lab in the U.S.", "Our loop in the U.S. office runs at 2.46 p.m. every day."],
    ['"It works. Really, it does!" says the comment above `a.b`, but the cache disagrees.', 'He wrote: "Close the parser first."', "The call (see lib/x.toml. It is short.) builds a new one."],
    ["It was fine in 4.1... then the slice broke.", "sys.quarel_step is slower by a factor of 2.306.", "`x = 1. / n` is fine.", "tuples fail with \"TypeError: bad parser.\" on start."],
    ["See sec. 206 of the notes (cf. also fig. 15) before you change b.toml.", "Version v4.7.2 shipped on Jan. 16.", "Most people pin the wheel, the lock file, etc.", "The value e.g. 53.2 vs. 80.9 depends on No. 36."],
    ["„Das geht nicht. Niemals!“, meinte Dr. Nimufen.", "Am 8. Mai wurde der Iterator in v0.7 entfernt.", "Prof. Galbaun nennt das in der 25. Auflage so.", "Der Cache, der Zeiger usw. werden neu gebaut.", "a.fill() ist z. B. für den Test gedacht.", "Siehe Abschn. 4 in b.cfg, bzw. die Hinweise."],
    ["« Ça marche. Vraiment ! » dit la note.", "Voir p. 93 et fig. 4 pour le module.", "M. Unporhin a écrit le test.", "N'appelez jamais le cache deux fois !", "Il prend env. 66 ms, c.-à-d. plus que prévu."],
    ["«Funciona. Siempre», dice la nota.", "EE. UU. no aparece en el caché.", "¿Por qué no?", "¡No uses el búfer!", "El Sr. Basolli y la Dra. Mixaka, p. ej. con 49 filas."],
    ["«Всё работает. Точно!» — пишет автор.", "См. рис. 208 в файле a.toml.", "А. Б. Вальнов изменил поток.", "Списки, журнал и т. д. строятся заново.", "Он занимает ок. 7 мс, т. е. слишком много."],
    ["«إنه يعمل. حقا!» هكذا يقول التعليق على السجل.", "كتب د. تيروما هذا المحلل.", "لماذا يعيد القيمة؟", "انظر a.cfg قبل التعديل؛ فهو قصير."],
    ["“यह चलता है। सच में!” ऐसा स्मृति की टिप्पणी कहती है।", "डॉ. वेलनार ने 4.11.4 में स्मृति जोड़ा।", "मान क्यों आता है?"],
    ["\"됩니다. 정말로!\" 라고 적혀 있습니다.", "0.3 부터 a() 가 대신합니다.", "왜 돌려주나요?"],
]


@pytest.mark.parametrize("parts", CASES)
def test_spaced_scripts(parts):
    assert units(" ".join(parts)) == parts
    assert units("\n".join(parts)) == parts  # a line break ends nothing by itself, and hides no end


@pytest.mark.parametrize(
    "parts",
    [
        ["说明里写道：“它能用。真的！”但是解析器并不同意。", "他说：“先关闭缓存。”", "这个模块比装饰器多。", "参见a.toml中的日志（第210页。很短）再改。", "结果还没有出来……", "为什么x()返回2.5？", "从1.11开始，y()取代了它。"],
        ["「動きます。本当に！」と注釈に書いてあります。", "詳しくはa.tomlのログ（第206章。短い）を見てください。", "まだ結果は出ていません……", "なぜxは7.7を返すのですか？"],
    ],
)
def test_scripts_without_spaces(parts):
    assert units("".join(parts)) == parts


def test_thai_spaces():
    assert units("อย่าแก้ไขแคชด้วยมือ โปรดดูแคชในไฟล์ a.gz ก่อนเปลี่ยน ค่าจะเป็น 7.2 เสมอ") == ["อย่าแก้ไขแคชด้วยมือ", "โปรดดูแคชในไฟล์ a.gz ก่อนเปลี่ยน", "ค่าจะเป็น 7.2 เสมอ"]


def test_layout():
    text = "# Head\r\n\r\nTitle\n=====\nFirst one. Second\none.\nNote:\n- item one. More.\n2. item two\n  goes on. End\n\n```py\nx = 1.\n\ny. Z\n```\n\n    code. More\n    A. B\n\n>>> f(1.)\n2. X\n \nLast"
    assert units(text) == ["# Head", "Title\n=====", "First one.", "Second\none.", "Note:", "- item one.", "More.", "2. item two\n  goes on.", "End", "```py\nx = 1.\n\ny. Z\n```", "code. More\n    A. B", ">>> f(1.)\n2. X", "Last"]
    assert ends(text)[-1] == len(text)


@pytest.mark.parametrize(
    "script, run, words",
    [
        ("zh", "但是我们不知道", ["但是", "我们", "不知道"]),
        ("zh", "这样说", ["这样", "说"]),
        ("ja", "本当にありがとう", ["本当", "に", "ありがとう"]),
        ("ja", "という", ["という"]),
        ("th", "ด้วยครับ", ["ด้วย", "ครับ"]),
    ],
)
def test_word_lattice(script, run, words):
    assert lattice(script).words(run) == words


def test_words_on_both_sides_of_a_gap():
    text = "他说：“它真的能用了！”但是字典并不同意。"
    assert around(text, 0, text.index("！"), text.index("但"), len(text), "zh") == ("了", "但是")


@pytest.mark.parametrize(
    "text, joined",
    [("“它能用。真的！”但是字典并不同意。再看。", "“它能用。真的！”"), ("「動きます。本当に！」と注釈に書いてあります。次。", "「動きます。本当に！」")],
)
def test_the_lattice_decides_behind_a_quotation(text, joined, monkeypatch):
    cut = len(joined)
    assert cut not in ends(text)
    monkeypatch.setattr(sentences.WordLattice, "words", lambda self, run: [run])
    assert cut in ends(text)


def test_particles_and_openers_shift_the_cost():
    cost = sentences._gap_cost
    assert cost(0, "zh", "了", "") < 0 < cost(0, "zh", "了", "但是") and cost(0, "ja", "です", "この") < cost(0, "ja", "です", "") < cost(0, "ja", "", "")


#: Texts of two sentences that the mark alone would cut otherwise.
WEIGHED = [
    ("我想说……但是没有时间。", "再看。"),
    ("彼は……と言った。", "次。"),
    ("なぜ動く？と聞かれました。", "次。"),
    ("すごい！との声が出た。", "次。"),
    ("模块太慢！的喊声很大。", "再看。"),
    ("モーニング娘。の新曲が出た。", "次。"),
    ("他（门已经关了！）没有回来。", "再看。"),
    ("他看了《加油！》节目。", "再看。"),
    ("ดีมาก! ซึ่งดี", ""),
]


@pytest.mark.parametrize("parts", WEIGHED)
def test_words_outweigh_a_mark(parts, monkeypatch):
    text, cut = "".join(parts), len(parts[0])
    inner = next(i for i, c in enumerate(text) if c in "…。！？!")
    first = ends(text)[0]
    assert inner < cut == first
    monkeypatch.setattr(sentences, "_gap_cost", lambda base, *words: min(base, -0.1))
    assert inner < ends(text)[0] < cut


@pytest.mark.parametrize("text, end", [("他已经走了……但是门还开着。", "……"), ("終わりました……でも遅い。", "……"), ("動きます。の新曲が出た。", "。")])
def test_final_particles_decide(text, end, monkeypatch):
    cut = text.index(end) + len(end)
    assert ends(text)[0] == cut
    monkeypatch.setattr(sentences, "_closes", lambda script, word: False)
    assert cut not in ends(text)


@pytest.mark.parametrize("text", ["他读了书（很短！）这个模块好。", "我看了《加油！》他很高兴。"])
def test_openers_decide(text, monkeypatch):
    cut = max(text.find("）"), text.find("》")) + 1
    assert ends(text)[0] == cut
    monkeypatch.setitem(sentences._FUNCTION, "zh", {w: k for w, k in sentences._FUNCTION["zh"].items() if k != "open"})
    assert cut not in ends(text)


@pytest.mark.parametrize(
    "parts",
    [["なぜ動く？", "でも速い。"], ["すごい！", "とりあえず保存します。"], ["真的吗？", "但是很慢。"], ["动作快！", "的确很好。"], ["没有了。", "然而还在。"], ["他没有来……", "后来我走了。"], ["动きます。", "が、遅い。"], ["第一句。", "（见第2章。）", "字典好。"]],
)
def test_words_that_outweigh_no_mark(parts):
    assert units("".join(parts)) == parts


def test_no_words_are_asked_at_a_space_of_thai(monkeypatch):
    asked = []
    monkeypatch.setattr(sentences, "around", lambda *a: asked.append(a) or ("", ""))
    assert units("ดูแคช ซึ่งเร็ว และดี") == ["ดูแคช", "ซึ่งเร็ว", "และดี"] and not asked


def test_gaps_take_linear_time():
    import time

    began = time.time()
    for text in ("我……" * 100000, "（好！）" * 70000, "あ（" + " " * 100000 + "好！）の" * 50000, "す。の" * 100000):
        ends(text)
    assert time.time() - began < 20


def test_marks_of_thai_stay_with_their_letters():
    import unicodedata

    assert not any(unicodedata.category(w[0]) == "Mn" for w in lattice("th").words("หน่วยความจำถูกลบออกแล้ว"))


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "q", 0), (2, "", "q", 0), (3, " \n\t", "q", 0), (4, "Ab cd. Ef gh.", "q", 0), (4, "Ab cd. Ef gh.", "q", 0), (None, "X.", "q", 0), (5, "Aa bb cc. " * 20000, "q", 0)], "doc_id long, text string, n string, end_pos int")
    got = sorted(((r["doc_id"] or 0), r["end_pos"]) for r in sentence_ends(df).filter("doc_id is null or doc_id < 5").collect())
    assert got == [(0, 2), (4, 6), (4, 6), (4, 13), (4, 13)]
    assert sentence_ends(df).filter("doc_id = 5").count() == 20000
    assert [r["unit"] for r in sentence_units(df.filter("doc_id = 4").limit(1)).orderBy("n").collect()] == ["Ab cd.", "Ef gh."]
    assert sentence_ends(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["...", "!!! ???", "(((", "\"\"\"", "「「。", "a. b. c. d. e. f. g. h.", "。。。", "​", "- ", "1. ", "```", "```\n", ">>>", "# ", "= =\n==", "«" * 500, "( . " * 300])
def test_odd_texts_end_where_they_end(text):
    e = ends(text)
    assert e == sorted(set(e)) and (not text.strip() or e[-1] == len(text.rstrip()))


@pytest.mark.parametrize("dots", [10, 11, 12, 30, 500])
def test_any_number_of_dots_that_end_nothing(dots):
    text = "So " + " ".join(f"word{'abcdefghij'[n % 10]} goes." for n in range(dots)) + " and so it ends"
    assert units("It begins. " + text + ". New one.") == ["It begins.", text + ".", "New one."]


def test_path_equals_all_paths():
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice("ab .-") for _ in range(rnd.randint(4, 40)))
        at = sorted(rnd.sample(range(1, len(text)), rnd.randint(1, min(9, len(text) - 1))))
        nodes = [(a, rnd.choice([1.0, -1.0, -0.5, 0.25])) for a in at]
        costs = dict(nodes)

        def total(out):
            return sum(costs.get(e, 0.0) for e in out[:-1]) + sum(3.0 for a, b in zip([0, *out], out) if not any(map(str.isalnum, text[a:b])))

        every = [[*some, len(text)] for k in range(len(at) + 1) for some in itertools.combinations(at, k)]
        if not all(c < 0 for _, c in nodes):
            assert total(_path(text, 0, len(text), nodes)) == min(map(total, every))


@pytest.mark.parametrize("pair", ['""', "„“", "“”", "«»", "‹›", "「」", "『』", "《》", "()", "（）", "[]", "【】"])
def test_pairs_of_any_length(pair):
    inside = "It works. " * 200 + "It ends."
    parts = [f"The note {pair[0]}{inside}{pair[1]} goes on here.", "New one."]
    assert units(" ".join(parts)) == parts


def test_brackets_nest_and_open_ones_are_text():
    assert units("See (a. B (c. D (e. F) g. H) i. J) here. New.") == ["See (a. B (c. D (e. F) g. H) i. J) here.", "New."]
    assert units("See (a thing. Next (b. C) here. New.") == ["See (a thing.", "Next (b. C) here.", "New."]


@pytest.mark.parametrize("text", ["(" * 200000, "()" * 100000, "“" * 200000, "[a " * 70000, '" ' * 100000])
def test_pairs_take_linear_time(text):
    import time

    began = time.time()
    ends(text)
    assert time.time() - began < 10
