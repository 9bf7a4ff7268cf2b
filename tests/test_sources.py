import json
import logging

import pytest
from pyspark.sql import functions as F

from quern.operators import execute
from quern.sources import benchmarks, config, results

TRAIN = {"micro_batch_size": 2, "grad_accum_steps": 8, "max_tokens": 2_000_000_000, "grad_clip": 1.0, "save_every_steps": 1, "eval_every_steps": 1, "log_every_steps": 1, "keep_last_n": 1, "train_data": "/no/such.bin", "lr_schedule": {"decay": "cosine", "warmup_steps": 0, "min_lr_ratio": 0.1}}
MODEL = {"n_layer": 24, "d_model": 512, "n_heads_q": 8, "n_heads_kv": 4, "head_dim": 64, "d_ffn": 1365, "vocab_size": 32000, "context_length": 2048, "dropout": 0.0, "dtype": "bfloat16"}


def test_configuration(tmp_path, caplog):
    import yaml

    p = tmp_path / "c.yaml"
    p.write_text(yaml.safe_dump(TRAIN))
    with caplog.at_level(logging.WARNING):
        c = config.load(str(p), "training")
    assert "such.bin" in caplog.text and config.tokens_per_step(c, 2048) == 32768 and config.total_steps(c, 2048) == 61035
    assert config.problems(TRAIN | {"grad_clip": 0, "keep_last_n": 0, "resume_from": "/no/where"}, "training") == ["grad_clip must be positive, not 0", "keep_last_n must be positive, not 0", "resume_from '/no/where' does not exist"]
    assert config.problems(TRAIN | {"resume_from": "Latest"}, "training") == []
    assert config.problems(TRAIN | {"lr_schedule": {"decay": "step", "warmup_steps": -1}}, "training") == ["lr_schedule.decay must be cosine, not 'step'", "lr_schedule.warmup_steps must be not negative, not -1", "lr_schedule.min_lr_ratio is missing"]
    assert config.problems(MODEL, "model") == [] and config.gqa(MODEL) == {"group_size": 2, "kv_dim": 256}
    assert config.problems(MODEL | {"head_dim": 63}, "model") and config.problems(MODEL | {"n_heads_kv": 3}, "model") and config.problems(MODEL | {"dtype": "int8"}, "model")
    p.write_text("vocab_size: 5\n")
    with pytest.raises(ValueError, match="output_dir is missing"):
        config.load(str(p), "tokenizer")
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.yaml"), "model")


def test_benchmarks(spark, tmp_path):
    def lines(name, rows):
        (tmp_path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n\n")
        return str(tmp_path / name)

    h = lines("h", [{"task_id": "X/10", "prompt": "a"}, {"task_id": "X/2", "prompt": "b", "more": 1}])
    assert [r["task_id"] for r in benchmarks.humaneval(spark, h).collect()] == ["X/2", "X/10"]
    m = lines("m", [{"task_id": 1, "text": "t", "code": "c", "test_list": ["a", "b"]}, {"task_id": 2, "test_setup_code": "import x"}])
    assert {r["task_id"]: r["test_setup_code"] for r in benchmarks.mbpp(spark, m).collect()} == {1: "", 2: "import x"}
    d = lines("d", [{"id": 1, "prompt": "p", "lib": "Numpy", "code_context": "c"}, "", {"metadata": {"problem_id": 7}, "prompt": "q", "library": "pandas", "test": "t", "reference_code": "r"}, {"id": None, "metadata": {"problem_id": 9}, "prompt": "s"}])
    rows = sorted(map(tuple, benchmarks.ds1000(spark, d).collect()), key=str)
    assert rows == sorted([("1", "p", "", "c", "Numpy"), ("7", "q", "r", "t", "pandas"), (None, "s", "", "", "Unknown")], key=str)
    assert benchmarks.ds1000(spark, d, "NUMPY").count() == 1
    b = lines("b", [{"task_id": "1", "prompt": "p", "complete_prompt": ""}, {"task_id": "2", "prompt": "p", "complete_prompt": "c"}])
    assert {r["task_id"]: r["prompt"] for r in benchmarks.bigcodebench(spark, b).collect()} == {"1": "p", "2": "c"}
    with pytest.raises(ValueError):
        benchmarks.evalplus(spark, b, "other")
    s = lines("s", [{"task_id": 3, "completion": "y"}, {"task_id": 3, "completion": "x"}, {"task_id": 4, "completion": ""}])
    assert {r["task_id"]: r["completions"] for r in benchmarks.samples(spark, s).collect()} == {"3": ["x", "y"], "4": [""]}


def test_documents(spark, tmp_path):
    ends = spark.createDataFrame([(1, 10), (2, 15), (3, 45)], "stage int, end_token long")
    doc = results.pack_metadata({"total_tokens": 45}, ends, pilot=True)
    assert doc == {"total_tokens": 45, "pilot": True, "stage_boundaries": {"stage1_end_token": 10, "stage2_end_token": 15, "stage3_end_token": 45, "stage3_upsample": 3}}
    assert "stage_boundaries" not in results.pack_metadata({"total_tokens": 1}, ends.limit(0))
    results.write_json(doc, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == doc and [p.name for p in tmp_path.iterdir()] == ["m.json"]
    got = json.loads(results.result_document(ends, suite="s").first()["value"])
    assert got["suite"] == "s" and len(got["results"]) == 3
    rows = spark.createDataFrame([("train", 2, {"loss": 1.5, "x": 1.0}), ("train", 1, {"loss": 2.5}), ("eval", 1, {"val": 0.5})], "tag string, step long, metrics map<string,double>")
    results.write_metrics(rows, str(tmp_path / "csv"))
    text = {k: [r["value"] for r in spark.read.text(str(tmp_path / f"csv/tag={k}")).collect()] for k in ("train", "eval")}
    assert text == {"train": ["step,loss", "1,2.5", "2,1.5"], "eval": ["step,val", "1,0.5"]}
    results.write_vocabulary(str(tmp_path / "v"))
    head = (tmp_path / "v/vocab.txt").read_text(encoding="utf-8").split("\n")
    meta = json.loads((tmp_path / "v/tokenizer_meta.json").read_text())
    assert len(head) - 1 == meta["vocab_size"] and head[7].startswith("7\t")


def test_samples_run_only_if_allowed(spark, monkeypatch):
    df = spark.createDataFrame([("a", 0, "assert 1 + 1 == 2"), ("a", 1, "assert False"), ("b", 0, "import time; time.sleep(60)"), ("c", 0, None), ("d", 0, "x = ("), ("e", 0, "print('é')")], "task_id string, sample_idx int, script string")
    with pytest.raises(PermissionError):
        execute.outcomes(df)
    monkeypatch.setitem(execute.TIMEOUTS, "mbpp", 2.0)
    got = {(r["task_id"], r["sample_idx"]): r["passed"] for r in execute.outcomes(df, "mbpp", allow_untrusted_code=True).collect()}
    assert got == {("a", 0): True, ("a", 1): False, ("b", 0): False, ("c", 0): False, ("d", 0): False, ("e", 0): True}
    assert df.select(F.count("*")).first()[0] == 6


def test_spreading_depends_on_files_alone(spark, tmp_path):
    from quern.sources import tables

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(10).repartition(4).write.parquet(str(tmp_path / "four"))
    one, four = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "four"))
    assert tables.scan_splits(one) == 1 and tables.scan_splits(four) == 4 and tables.scan_splits(spark.range(5)) is None
    assert tables.spread(one) is not one and tables.spread(four) is four
    assert tables.spread(one).count() == 1000
