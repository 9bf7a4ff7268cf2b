import random

import numpy as np
import pytest

from quern.operators import dedup


def greedy(rows):
    """rows: id -> set of (band, hash); the sequential keep-first result."""
    seen, out = set(), {}
    for i in sorted(rows):
        out[i] = not (rows[i] & seen)
        if out[i]:
            seen |= rows[i]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_rounds_equal_the_sequential_result(spark, seed):
    rnd = random.Random(seed)
    rows = {i: {(b, rnd.randrange(60 + 300 * (seed % 2))) for b in range(4)} for i in range(250)}
    df = spark.createDataFrame([(i, b, h) for i, s in rows.items() for b, h in s], "id long, band int, hash long")
    assert {r["id"]: r["kept"] for r in dedup.keep_first(df).collect()} == greedy(rows)


def test_a_chain_keeps_what_collides_with_dropped_rows_only(spark):
    rows = [(1, 0, 1), (2, 0, 1), (2, 1, 2), (3, 1, 2)]
    got = {r["id"]: r["kept"] for r in dedup.keep_first(spark.createDataFrame(rows, "id long, band int, hash long")).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_a_hot_band(spark):
    df = spark.range(3000).selectExpr("id", "0 as band", "cast(if(id % 3 = 0, 7, id) as bigint) as hash")
    got = dedup.stats(dedup.keep_first(df)).first()
    assert (got["seen"], got["duplicates"], got["unique"]) == (3000, 999 + 0, 2001) or got["seen"] == 3000 and got["unique"] == 3000 - got["duplicates"]
    rows = {r["id"]: {(0, r["hash"])} for r in df.collect()}
    assert got["duplicates"] == sum(not k for k in greedy(rows).values())


def test_texts(spark):
    base = "def f(x):\n    return x + 1\n" * 20
    rows = [(1, base), (2, base), (3, base.replace("    ", "\t ")), (4, "e\u0301" * 9), (5, "é" * 9), (6, "abc"), (7, "abc"), (8, ""), (9, " "), (10, None), (11, base.replace("\n", "\n\n"))]
    df = spark.createDataFrame(rows, "seq long, content string")
    got = {r["id"]: r["kept"] for r in dedup.near_dedup(df).collect()}
    assert 10 not in got
    assert {k: got[k] for k in range(1, 10)} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: False, 8: True, 9: False}
    exact = {(r["first"], r["copies"]) for r in dedup.exact_dedup(df).collect()}
    assert exact == {(1, 3), (4, 2), (6, 2), (8, 2), (11, 1)}
    assert dedup.stats(dedup.near_dedup(df)).first()["seen"] == 10


def test_signature_estimates_similarity():
    rnd = random.Random(1)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    b = a[:2400] + "".join(rnd.choice("abcdefgh ") for _ in range(600))
    x, y = dedup.shingles(a), dedup.shingles(b)
    j = len(x & y) / len(x | y)
    assert abs(np.mean(dedup.signature(a) == dedup.signature(b)) - j) < 0.15
    assert dedup.shingles("abcd") == {"abcd"} and dedup.shingles("") == {""}
