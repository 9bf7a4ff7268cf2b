import io
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import tokens as tok
from quern.operators import evaluation, packing
from quern.operators.prefix import running_sum
from quern.sources import packed, tables


def test_running_sum_is_a_global_prefix_sum(spark):
    rows = [(i // 7, i, (i * 13) % 11 if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, v long").repartition(5)
    got = [(r["b"], r["s"]) for r in running_sum(df, ["a", "b"], F.coalesce("v", F.lit(0)), "s", 7).orderBy("b").collect()]
    want, total = [], 0
    for _, b, v in rows:
        want.append((b, total))
        total += v or 0
    assert got == want
    assert running_sum(df.limit(0), ["a", "b"], "v", "s").count() == 0


def cursor(n, ctx, rows, start):
    pos, epoch, out = start, 0, []
    for _ in range(rows):
        if pos + ctx + 1 > n:
            pos, epoch = 0, epoch + 1
        out.append((epoch, pos))
        pos += ctx
    return out


@pytest.mark.parametrize("n,ctx,start", [(9, 8, 0), (17, 8, 0), (100, 8, 0), (33, 8, 5), (33, 8, 32), (24, 8, 17), (1000, 7, 999)])
def test_batch_rows_follow_the_cursor(spark, n, ctx, start):
    got = [(r["epoch"], r["start"]) for r in packing.batch_rows(spark, n, ctx, 40, 3, start).orderBy("row").collect()]
    assert got == cursor(n, ctx, 40, start)


def test_batch_rows_check_their_bounds(spark):
    for n, start in ((8, 0), (9, 9), (9, -1)):
        with pytest.raises(ValueError):
            packing.batch_rows(spark, n, 8, 1, 1, start)


@pytest.mark.parametrize("n", [9, 16, 17, 25, 100])
def test_sequences(spark, n):
    rows = packing.sequences(spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * 3).cast("int").alias("token")), 8).orderBy("start").collect()
    assert [r["start"] for r in rows] == [k * 8 for k in range((n - 1) // 8)]
    for r in rows:
        assert list(r["x"]) == [3 * (r["start"] + k) for k in range(8)] and list(r["y"]) == [3 * (r["start"] + k + 1) for k in range(8)]


@pytest.mark.parametrize("chunks,val", [(1, 1), (19, 1), (20, 1), (40, 2), (100, 5)])
def test_chunk_split_is_exact_and_disjoint(spark, chunks, val):
    rows = packing.chunk_split(spark, chunks).collect()
    assert sorted(r["chunk_id"] for r in rows) == list(range(chunks)) and sum(r["split"] == "val" for r in rows) == val


def test_no_chunk_gives_no_rows(spark):
    assert packing.chunk_split(spark, 0).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 31, 32, 33, 40, 41, 100])
def test_windows(spark, n):
    ctx, stride, want, begin = 32, 8, [], 0
    while n >= 2:
        end = min(begin + ctx, n)
        want.append((begin, end, end - begin - 1 if begin == 0 else min(stride, end - begin - 1)))
        if end == n:
            break
        begin += stride
    df = spark.createDataFrame([(n,)], "n long")
    got = [(r["begin"], r["end"], r["n_new"]) for r in evaluation.windows(df, "n", ctx, stride).orderBy("begin").collect()]
    assert got == want


def test_packed_file(spark, tmp_path):
    packed.register(spark)
    rows = [(i, [i % 65536, 65535, 0][: i % 4]) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, ids array<int>").repartition(6)
    folder = str(tmp_path / "out")
    said = packed.write(packed.arranged(df, ["seq"], 4), "ids", folder)
    flat = [t for _, ids in rows for t in ids]
    assert said["total_tokens"] == len(flat) == packed.token_count(folder) and said["total_files"] == 300
    got = spark.read.format("packed_tokens").option("path", folder).option("stripe", 50).load().orderBy("pos").collect()
    assert [r["token"] for r in got] == flat and [r["pos"] for r in got] == list(range(len(flat)))
    assert np.concatenate([np.fromfile(f, np.uint16) for f in packed.part_files(folder)]).tolist() == flat
    with pytest.raises(FileExistsError):
        packed.write(df, "ids", folder)
    with pytest.raises(Exception, match="16 bits"):
        packed.write(spark.createDataFrame([(1, [65536])], "seq long, ids array<int>"), "ids", str(tmp_path / "bad"))
    with pytest.raises(Exception):
        packed.token_count(str(tmp_path / "missing"))


def test_tokenizer(spark):
    texts = ["", None, "def f(x):\n    return x\n", "a\tb  c\n", "é 中文 😀", "<|endoftext|>", "x = 1\n" * 10000, "    y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", tok.encode(F.col("t")).alias("a"), tok.encode(F.col("t"), add_eof=True).alias("b")).orderBy("i").collect()
    end = tok.special_ids()["eof"]
    t = tok.tokenizer(tok.FILE)
    for r, text in zip(rows, texts):
        assert r["b"] == r["a"] + [end] and r["a"] == t.encode(text or "", add_special_tokens=False).ids and end not in r["a"]
    back = df.select(tok.encode(F.col("t")).alias("a"), "i").select("i", tok.decode(F.col("a")).alias("d"), F.size(tok.padded(F.col("a"), 9, end)).alias("w")).orderBy("i").collect()
    assert [r["d"] for r in back] == [x or "" for x in texts] and all(r["w"] >= 9 for r in back)
    vocab = tok.vocabulary(spark)
    assert vocab.count() == t.get_vocab_size() and vocab.agg(F.max("id")).first()[0] < 65536


def test_jsonl_and_files(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"source": "a", "tag": "x"}\n\n   \n{"source": "b"\n{"source": "c"}\n{"tag": "y", "source": "d", "more": 1}\nnull\n')
    assert sorted((r["source"], r["tag"]) for r in tables.jsonl(spark, str(p)).collect()) == [("a", "x"), ("d", "y")]
    assert tuple(tables.jsonl_report(spark, str(p)).first()) == (2, 3)
    os.makedirs(tmp_path / "t/b")
    (tmp_path / "t/b/z.py").write_text("z\n1")
    (tmp_path / "t/a.py").write_text("a")
    (tmp_path / "t/no.txt").write_text("n")
    assert [r["content"] for r in tables.source_tree(spark, str(tmp_path / "t")).collect()] == ["a", "z\n1"]
    with tarfile.open(tmp_path / "r.tar.gz", "w:gz") as tar:
        for name, data in (("r/b.py", b"b\xff"), ("r/a.py", b"a"), ("r/blank.py", b" \n"), ("r/c.txt", b"c"), ("r/d.py", b"d")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rows = [(r["path"], r["content"]) for r in tables.archives(spark, str(tmp_path / "r.tar.gz")).collect()]
    assert rows == [("r/a.py", "a"), ("r/b.py", "b"), ("r/d.py", "d")]
    assert tables.archives(spark, str(tmp_path / "r.tar.gz"), limit=2).count() == 2
    names = spark.createDataFrame([("step_000100", True), ("step_000100.tmp", True), ("crash_000500", True), ("step_abc", True), ("step_7", False), ("step_000200", True)], "name string, is_dir boolean")
    assert sorted(r["step"] for r in tables.checkpoints(spark, names).collect()) == [100, 200]


def test_golden_ids_and_bounds_of_the_encoder(spark):
    import json
    import time
    from pathlib import Path

    cases = json.loads((Path(__file__).parent / "golden_tokens.json").read_text())
    df = spark.createDataFrame([(i, c["text"]) for i, c in enumerate(cases)], "i int, t string")
    got = [list(r["ids"]) for r in df.select("i", tok.encode(F.col("t")).alias("ids")).orderBy("i").collect()]
    assert got == [c["ids"] for c in cases]
    text = "\n\n".join(c["text"] for c in cases) * 40
    fast = tok.ranks(tok.FILE)
    ids = fast.encode_ordinary(text)
    assert fast.decode(ids) == text  # characters a token are a property of the public vocabulary, so no bound on them
    began = time.time()
    n = sum(len(fast.encode_ordinary(text)) for _ in range(20))
    assert n / (time.time() - began) > 500_000
    assert len(fast.encode_ordinary("x = 1\n" * 20_000)) > 0


def test_token_files_refuse_paths_that_are_not_mounted():
    with pytest.raises(ValueError, match="mounted"):
        packed.part_files("hdfs://host/x")


def test_chunk_split_takes_the_smallest_hashes(spark):
    import hashlib

    n = 3000
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"{i}-42".encode()).hexdigest(), i))
    got = {r["chunk_id"] for r in packing.chunk_split(spark, n).filter("split = 'val'").collect()}
    assert got == set(order[:150])
