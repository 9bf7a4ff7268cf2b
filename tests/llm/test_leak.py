from quern.llm import leak

ITEM = "def f(x):\n    \"\"\"Find the lightest pair of hollow bells counted twice after the mirrored reef, but stop.\"\"\"\n"


def brute(rows, items, width=leak.WIDTH):
    grams = {}
    for suite, task, text in items:
        w = leak.words(text)
        for i in range(len(w) - width + 1):
            grams.setdefault(tuple(w[i : i + width]), set()).add((suite, task))
    out = set()
    for seq, text in rows:
        w = leak.words(text)
        for i in range(len(w) - width + 1):
            out |= {(seq, *t) for t in grams.get(tuple(w[i : i + width]), ())}
    return out


def test_against_brute_force(code, source, words):
    items = [("a", "1", ITEM), ("a", "1", ITEM + " more"), ("b", "1", " ".join(words[:40])), ("b", "2", "too short"), ("b", "3", None), ("c", "9", " ".join(words[20:60]))]
    w = leak.words(ITEM)
    rows = [
        (1, source(1) + "# " + "\n# ".join(w[2:9]) + "\n#   " + " -- ".join(w[9:15]) + "\n" + source(2)),
        (2, source(3) + " ".join(w[:11])),
        (3, " ".join(w[1:13]).upper()),
        (4, None),
        (5, ""),
        (6, " ".join(words[18:45])),
        (7, "_".join(words[5:30])),
        (8, source(4, 2000) + " ".join(words[22:34])),
        (9, " ".join(words[0:11] + ["x"] + words[11:22])),
        (9, " ".join(w)),
    ]
    df = code([{"seq": s, "content": t} for s, t in rows])
    got = {(r["seq"], r["suite"], r["task_id"]) for r in leak.leaks(df, items).collect()}
    assert got == brute(rows, items)
    assert {g[0] for g in got} == {1, 3, 6, 7, 8, 9}


def test_shared_counts_windows_and_blocks_agree(code, words, monkeypatch):
    items = [("b", str(k), " ".join(words[k : k + 30])) for k in range(0, 90, 30)]
    df = code([{"seq": 1, "content": " ".join(words[0:90])}, {"seq": 2, "content": " ".join(words[35:50])}])
    whole = sorted(map(tuple, leak.leaks(df, items).collect()))
    assert whole == [(1, "b", "0", 19), (1, "b", "30", 19), (1, "b", "60", 19), (2, "b", "30", 4)]
    monkeypatch.setattr(leak, "BLOCK", 7)
    assert sorted(map(tuple, leak.leaks(df, items).collect())) == whole


def test_empty(code):
    assert leak.leaks(code([]), [("a", "1", ITEM)]).count() == 0
    assert leak.leaks(code([{"seq": 1, "content": ITEM}]), []).count() == 0
