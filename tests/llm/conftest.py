import json
import random

import pytest

SCHEMA = "seq long, content string, max_stars_repo_name string, max_stars_repo_path string, lang string, id string, key string, n int"


@pytest.fixture(scope="session")
def code(spark):
    """Rows of a code table from dicts, with extra columns whose names clash with those operators use inside."""

    def make(rows):
        return spark.createDataFrame([(r.get("seq"), r.get("content"), r.get("repo"), r.get("path", "src/a.py"), r.get("lang", "Python"), "x", None, 1) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(7)
    return ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def source(words):
    """A plausible Python file of some length."""

    def make(seed, lines=40):
        rnd = random.Random(seed)
        out = []
        for _ in range(lines):
            a, b, c, d = rnd.sample(words, 4)
            n = rnd.randint(1, 9999)
            body = [
                f"    # {' '.join(rnd.sample(words, 5))}",
                f"    for {d} in range({n}):\n        {b}[{json.dumps(a)}] = {d} * {n % 7}",
                f"    if {b} > {n} and not {c}:\n        raise ValueError({json.dumps(' '.join(rnd.sample(words, 4)))})",
                f"    {d} = [{a}.{c} for {a} in {b} if {a}]",
                f"    with open({b}) as {d}:\n        {c} = {d}.read({n})",
                f"    while {b}:\n        {c}, {b} = {b}, {c} - {n}",
                f"    assert {c} is not None",
            ]
            out.append(f"def {a}_{n}({b}, {c}={n % 99}):\n" + "\n".join(rnd.sample(body, rnd.randint(1, 3))) + f"\n    return {b}.{c}({json.dumps(rnd.choice(words))}) + {n}")
        return "\n".join(out) + "\n"

    return make
