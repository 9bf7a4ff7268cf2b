import random

import numpy as np
import pytest

from quern.llm import origin


def verdicts(code, rows):
    return {r["id"]: r["reason"] for r in origin.verdicts(code(rows)).collect()}


def generated(seed):
    r = random.Random(seed)
    return "# Code generated by maker; DO NOT EDIT.\n" + "".join(f"_F{i} = _d.Field(name='n{i}', index={i}, number={r.randint(1, 500)}, type={r.randint(1, 9)})\n" for i in range(20))


def minified(seed):
    r = random.Random(seed)
    return "/*! lib v1 */\n" + "".join(f"var a{r.randint(1, 9)}={{b:{r.randint(1, 999)},c:!0}};function f{i}(x,y){{return x.z?y.w({i}):void 0}}" for i in range(20))


def numbers(seed):
    r = random.Random(seed)
    return "TABLE = [\n" + "".join("    " + ", ".join(str(r.randint(1, 99999)) for _ in range(9)) + ",\n" for _ in range(30)) + "]\n"


@pytest.fixture(scope="module")
def found(code, source):
    rows = []
    for k in range(120):
        rows.append({"seq": 1000 + k, "content": "# Copyright 2012 the contributors.\n" + source(k), "repo": "a/b"})
        rows.append({"seq": 2000 + k, "content": generated(k), "repo": "a/b"})
        rows.append({"seq": 3000 + k, "content": minified(k), "repo": "a/b", "path": "x/y.js"})
        rows.append({"seq": 4000 + k, "content": numbers(k), "repo": "a/b"})
    one = {
        1: {"content": generated(500).split("\n", 1)[1]},  # no notice
        2: {"content": minified(500).split("\n", 1)[1], "path": "x/y.js"},
        3: {"content": numbers(500)},
        4: {"content": "# This file is part of the melon library.\n" + source(501), "repo": "u/melon"},
        5: {"content": "# This file is part of the melon library.\n" + source(501), "repo": "u/other"},
        6: {"content": source(502), "path": "src/third_party/q/x.py"},
        7: {"content": source(503) + 'TEMPLATE = "# Code generated by x; DO NOT EDIT"\n'},
        8: {"content": source(504) + "\n# NOTE: hand written. An earlier version was auto-generated, this one is not.\nx = 1\n"},
        9: {"content": "x = 1\n", "path": "vendor/x.py"},
        10: {"content": None, "path": "vendor/x.py"},
        11: {"content": "# Licensed under the terms of the MIT licence.\n" + source(505)},
        12: {"content": source(506) + "T = {'a': 1, 'b': 2, 'c': 3}\n"},
        13: {"content": source(507) + "#\n# *** maker output -- hands off, rerun `maker` ***\n#\n"},
        14: {"content": "# vendored from melon (commit 12ab)\n" + source(508), "repo": None},
        15: {"content": source(509, 3000)},
        16: {"content": source(510, 80) + "\n/* Code generated by maker; DO NOT EDIT. */\n" + source(511), "path": "x.js"},  # far down
        17: {"content": source(512) + 'PAGE = """\n# Code generated by maker; DO NOT EDIT.\n"""\n'},  # in a string
        18: {"content": "<!DOCTYPE html>\n<html>\n" + "<p class='a1'>one two</p>\n" * 40},  # a page of another language
        19: {"content": "import zlib, base64\nexec(zlib.decompress(base64.b64decode('" + "".join(random.Random(5).choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1500)) + "')))\n"},
    }
    rows += [{"seq": k, "repo": "a/b"} | v for k, v in one.items()] + [{"seq": None, "content": generated(1)}]
    return verdicts(code, rows)


def test_notices_forms_and_decoys(found):
    special = {k: v for k, v in found.items() if k < 1000}
    assert special == {1: "generated", 2: "packed", 3: "data", 5: "third", 6: "vendored", 13: "tool", 14: "third", 16: "tool", 19: "packed"}


def test_held_out_accuracy(found):
    hand = [k for k in found if 1000 <= k < 2000]
    assert not hand
    for lo in (2000, 3000, 4000):
        assert sum(lo <= k < lo + 1000 for k in found) == 120


def test_the_forest_decides_for_files_without_a_statement(code, source, monkeypatch):
    rows = [{"seq": k, "content": generated(k) if k < 40 else "# Copyright 2012 the contributors.\n" + source(k)} for k in range(80)] + [{"seq": 100, "content": numbers(1)}, {"seq": 101, "content": generated(50).split("\n", 1)[1]}]
    assert {k for k in verdicts(code, rows) if k >= 40} == {100, 101}
    monkeypatch.setattr(origin, "fit_forest", lambda rows: None)
    assert set(verdicts(code, rows)) == set(range(40))


def test_labels_come_from_notices_only(code):
    """The same bodies without a notice have no label, whatever they look like."""
    bodies = [generated(1).split("\n", 1)[1], numbers(2), minified(3).split("\n", 1)[1]]
    rows = [{"seq": k, "content": b} for k, b in enumerate(bodies)] + [{"seq": 10 + k, "content": "# Code generated by maker; DO NOT EDIT.\n" + b} for k, b in enumerate(bodies)]
    got = {r["id"]: r for r in origin.described(code(rows), "seq", "content", "max_stars_repo_name", "max_stars_repo_path").collect()}
    names = [f"f{k}" for k in range(len(origin.FEATURES))]
    for k in range(3):
        assert got[k]["label"] is None and got[10 + k]["label"] == 1
        assert [got[k][n] for n in names] == [got[10 + k][n] for n in names]


def test_forest_learns_a_rule_and_is_repeatable():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5)).astype(int)
    a, b = origin.Forest.fit(x[:1500], y[:1500]), origin.Forest.fit(x[:1500], y[:1500])
    p = a.predict(x[1500:])
    assert ((p >= 0.5) == y[1500:]).mean() > 0.95 and (p == b.predict(x[1500:])).all()


def test_without_labels_only_notices_and_folders_count(code, source):
    assert verdicts(code, [{"seq": 1, "content": source(1)}, {"seq": 2, "content": source(2), "path": "deps/a/b.py"}]) == {2: "vendored"}
    assert verdicts(code, []) == {}
