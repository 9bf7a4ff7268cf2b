import numpy as np
import pytest

from quern.llm import mixture


@pytest.fixture(scope="module")
def inputs(spark):
    rows = [("stack", i, 100 + i % 37) for i in range(3000)] + [("curated", i, 150) for i in range(300)] + [("stdlib", i, 90) for i in range(40)] + [("stackoverflow", i, 60 + i % 9) for i in range(900)]
    sizes = spark.createDataFrame(rows, "source string, row_id long, size int")
    targets = spark.createDataFrame([("stack", 0.6, 1), ("curated", 0.2, 3), ("stdlib", 0.1, 2), ("stackoverflow", 0.1, 8), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    return sizes, targets


def test_quotas_repeats_and_places(inputs):
    sizes, targets = inputs
    have = {(r["source"], r["row_id"]): r["size"] for r in sizes.collect()}
    out = mixture.mix(sizes, targets, block=16, shard_chars=40_000).collect()
    total = sum(v for (s, _), v in have.items() if s == "stack") / 0.6
    share, cap = {r["source"]: r["target_share"] for r in targets.collect()}, {r["source"]: r["max_repeats"] for r in targets.collect()}
    got, copies = {}, {}
    for r in out:
        assert have[r["source"], r["row_id"]] == r["size"]
        got[r["source"]] = got.get(r["source"], 0) + r["size"]
        copies.setdefault((r["source"], r["row_id"]), []).append(r["repeat"])
    for (s, _), c in copies.items():
        assert sorted(c) == list(range(1, len(c) + 1)) and len(c) <= cap[s]
    for s in got:
        most = sum(v for (x, _), v in have.items() if x == s) * cap[s]
        want = min(share[s] * total, most)
        assert want - 400 <= got[s] <= want + 1
        mine = [len(c) for (x, _), c in copies.items() if x == s] + [0] * (sum(x == s for x, _ in have) - sum(x == s for x, _ in copies))
        assert max(mine) - min(mine) <= 1
    shards = {}
    for r in out:
        shards.setdefault(r["shard"], []).append(r["pos"])
    assert all(sorted(p) == list(range(len(p))) for p in shards.values()) and len(shards) > 5
    again = mixture.mix(sizes.repartition(3), targets, block=16, shard_chars=40_000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_every_shard_is_mixed(inputs):
    out = mixture.mix(*inputs, block=4, shard_chars=60_000).groupBy("shard").pivot("source").count().fillna(0).collect()
    assert all(min(r["stack"], r["curated"], r["stackoverflow"]) > 0 for r in out)


def test_shares(inputs):
    sizes, targets = inputs
    rows = {r["source"]: r for r in mixture.shares(mixture.mix(sizes, targets), sizes, targets).collect()}
    assert sum(r["actual_share"] for r in rows.values()) == pytest.approx(1)
    assert rows["stdlib"]["capped"] and rows["stdlib"]["chosen_chars"] == 40 * 90 * 2 and rows["stdlib"]["most_repeats"] == 2
    assert rows["none"]["chosen_rows"] == 0 and rows["stack"]["chosen_rows"] == 3000 and not rows["curated"]["capped"]


def test_splitting_tree_is_exact():
    counts, sizes = np.array([500, 30, 7, 0]), np.array([100, 100, 100, 100, 137])
    q = mixture.split(counts, sizes, 1)
    assert (q.sum(axis=0) == counts).all() and (q.sum(axis=1) == sizes).all() and (q >= 0).all()
    assert (mixture.split(counts, sizes, 1) == q).all() and (mixture.split(counts, sizes, 2) != q).any()


def test_no_rows(spark, inputs):
    empty = inputs[0].limit(0)
    assert mixture.mix(empty, inputs[1]).count() == 0
    assert mixture.shares(mixture.mix(empty, inputs[1]), empty, inputs[1]).count() == 5


def test_sources(spark):
    stack = spark.createDataFrame([(1, "x" * 9, "a/b"), (2, None, "a/b"), (3, " \n", "a/b"), (4, "yy", None), (5, "zz", "cur/one"), (6, "w", "")], "seq long, content string, max_stars_repo_name string")
    posts = spark.createDataFrame([(1, 10, 1, 7, 20, ["Python-3"], "q one"), (2, 20, 2, None, None, None, "answer"), (3, 11, 1, 9, 20, ["python"], "the last"), (4, 12, 1, 4, 21, ["python"], "low"), (5, 21, 2, 1, None, None, "none"), (6, 20, 2, 1, None, None, ""), (7, 13, 1, 9, 22, None, "untagged"), (8, 22, 2, 1, None, None, "a")], "seq long, Id long, PostTypeId int, Score int, AcceptedAnswerId long, Tags array<string>, Body string")
    files = spark.createDataFrame([(1, "cur/one", "abc"), (2, "std/lib", "\t"), (3, "std/lib", "de"), (4, "no/where", "f")], "file_seq long, repo string, content string")
    repos = spark.createDataFrame([("cur/one", "curated"), ("std/lib", "stdlib")], "repo string, tag string")
    got = sorted(map(tuple, mixture.sources(stack, posts, files, repos).collect()))
    assert got == [("curated", 1, 3), ("stack", 1, 9), ("stack", 4, 2), ("stack", 6, 1), ("stackoverflow", 2, len("Question:\nthe last\n\nAnswer:\nanswer")), ("stdlib", 3, 2)]
