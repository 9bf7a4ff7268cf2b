import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import golay, neardup


def brute(texts, threshold=0.85):
    sets = {}
    for i, t in texts.items():
        if t is None:
            continue
        t = neardup.normalise(t)
        if len(t) >= neardup.MIN_CHARS:
            sets[i] = {t[k : k + 5] for k in range(len(t) - 4)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_golay_words_within_two_bits_share_a_codeword():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 1 << 23, 3000)
    for errors in range(3):
        u = w.copy()
        for i in range(len(u)):
            for b in rng.choice(23, errors, replace=False):
                u[i] ^= 1 << int(b)
        for a, b in zip(golay.decode(w), golay.decode(u)):
            assert set(a[a >= 0]) & set(b[b >= 0])


def test_golay_indices_name_codewords():
    w = np.arange(0, 1 << 23, 4099)
    for word, row in zip(w, golay.decode(w)):
        for index in row[row >= 0]:
            code = next(c for c in ((int(index) << 11) | p for p in range(2048)) if golay._remainder(c) == 0)
            assert bin(code ^ int(word)).count("1") <= 4


@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x3FFF), min_size=5, max_size=60), st.text(min_size=5, max_size=60))
@settings(max_examples=80, deadline=None)
def test_jaccard_is_exact(a, b):
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    assert neardup.jaccard(a, b) == pytest.approx(len(x & y) / len(x | y))


def edited(text, rnd, share):
    lines = text.split("\n")
    for _ in range(int(len(lines) * share)):
        lines[rnd.randrange(len(lines))] = "    changed = %d" % rnd.randrange(10**6)
    return "\n".join(lines)


@pytest.fixture(scope="module")
def texts(source):
    rnd = random.Random(5)
    rows = {}
    for k in range(60):
        base = source(k)
        rows[len(rows)] = base
        for share in (0.01, 0.03, 0.05, 0.08, 0.15):
            rows[len(rows)] = edited(base, rnd, share)
    rows[len(rows)] = rows[0]  # copies
    rows[len(rows)] = rows[0].replace("\n", "  \n") + "   "
    rows[len(rows)] = rows[6].replace("    ", "\t")
    rows[len(rows)] = None
    rows[len(rows)] = ""
    rows[len(rows)] = "short"
    rows[len(rows)] = "short"
    rows[len(rows)] = "é" * 30 + source(99)
    rows[len(rows)] = "e\u0301" * 30 + source(99)  # the same in another normal form
    rows[len(rows)] = "𝒙" + source(98, 300) * 3  # long, beyond the first planes
    rows[len(rows)] = "𝒙" + source(98, 300) * 3
    return rows


def test_pairs_match_brute_force(code, texts):
    df = code([{"seq": i, "content": t} for i, t in texts.items()] + [{"seq": None, "content": texts[0]}])
    got = {tuple(r) for r in neardup.row_pairs(*neardup.similar_classes(df)).collect()}
    assert got == brute(texts)


def test_groups_cover_every_row_once(code, texts):
    df = code([{"seq": i, "content": t} for i, t in texts.items()])
    links, members = neardup.similar_classes(df)
    rows = neardup.groups(links, members).collect()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    pairs = brute(texts)
    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    long_enough = {i for i, t in texts.items() if t and len(neardup.normalise(t)) >= neardup.MIN_CHARS}
    assert sorted(r["seq"] for r in rows) == sorted(long_enough)
    assert {r["seq"]: r["group_id"] for r in rows} == {i: root(i) for i in long_enough}


def test_one_class_of_copies_and_an_empty_table(code, source):
    df = code([{"seq": i, "content": source(1)} for i in range(40)])
    assert neardup.row_pairs(*neardup.similar_classes(df)).count() == 40 * 39 // 2
    assert neardup.row_pairs(*neardup.similar_classes(code([]))).count() == 0


@pytest.mark.parametrize("width", [2, 3, 4])
def test_two_errors_in_a_band_always_leave_a_common_key(width):
    rng = np.random.default_rng(width)
    a = rng.integers(0, 1 << 23, (4000, width))
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(23 * width, int(rng.integers(0, 3)), replace=False):
            b[i, bit // 23] ^= 1 << int(bit % 23)
    (at_a, key_a), (at_b, key_b) = neardup.keys(a, width), neardup.keys(b, width)
    both = set(zip(at_a.tolist(), key_a.tolist())) & set(zip(at_b.tolist(), key_b.tolist()))
    assert {i for i, _ in both} == set(range(len(a)))


def test_keys_of_random_bands_seldom_meet():
    rng = np.random.default_rng(9)
    at, key = neardup.keys(rng.integers(0, 1 << 23, (5000, 2)), 2)
    assert 8 < len(key) / 5000 < 11
    assert (np.unique(key, return_counts=True)[1] > 20).sum() == 0


@pytest.mark.parametrize("size", [96, 400, 2000])
def test_recall_at_the_threshold(size):
    rng = np.random.default_rng(size)
    width, bands = neardup.shape(size)
    common = round(2 * size * 0.85 / 1.85)
    sets = [[], []]
    for _ in range(1500):
        u = rng.integers(1, 1 << 63, common, dtype=np.uint64)
        for s in sets:
            s.append(np.sort(neardup._mix(np.concatenate((u, rng.integers(1, 1 << 63, size - common, dtype=np.uint64))))))
    prints = [neardup.sketch(s, width * bands) for s in sets]
    found = [set(zip(*(x.tolist() for x in neardup.keys(p, width)))) for p in prints]
    met = {i for i, _ in found[0] & found[1]}
    assert len(met) >= 1497
    differ = np.array([[bin(x ^ y).count("1") for x, y in zip(p, q)] for p, q in zip(*(p.tolist() for p in prints))]).sum(axis=1)
    assert (differ <= neardup.allowed_bits(0.85, width * bands * golay.LENGTH)).all()


def test_wider_bands_give_the_same_pairs(code, texts, monkeypatch):
    monkeypatch.setattr(neardup, "shape", lambda rows: neardup.SHAPES[1][:2])
    df = code([{"seq": i, "content": t} for i, t in list(texts.items())[:80]])
    got = {tuple(r) for r in neardup.row_pairs(*neardup.similar_classes(df)).collect()}
    assert got == brute(dict(list(texts.items())[:80]))
