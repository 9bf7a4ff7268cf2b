"""Run configuration from YAML: a mapping checked against declared rules; derived quantities are functions of it."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Mapping
from typing import Any

log = logging.getLogger(__name__)

#: Rules by kind of configuration: dotted key, what its value must be, and the test.
POSITIVE: tuple[str, Callable[[Any], bool]] = ("positive", lambda v: v > 0)
RULES: dict[str, dict[str, tuple[str, Callable[[Any], bool]]]] = {
    "training": {
        **{k: POSITIVE for k in ("micro_batch_size", "grad_accum_steps", "max_tokens", "grad_clip", "save_every_steps", "eval_every_steps", "log_every_steps", "keep_last_n")},
        "lr_schedule.decay": ("cosine", lambda v: v == "cosine"),
        "lr_schedule.warmup_steps": ("not negative", lambda v: v >= 0),
        "lr_schedule.min_lr_ratio": ("in [0, 1]", lambda v: 0.0 <= v <= 1.0),
    },
    "model": {
        **{k: POSITIVE for k in ("n_layer", "d_model", "n_heads_q", "n_heads_kv", "head_dim", "d_ffn", "vocab_size", "context_length")},
        "dropout": ("in [0, 1]", lambda v: 0.0 <= v <= 1.0),
        "dtype": ("float32, float16 or bfloat16", lambda v: v in ("float32", "float16", "bfloat16")),
    },
    "tokenizer": {k: ("given", lambda v: v is not None) for k in ("vocab_size", "output_dir", "special_tokens", "min_frequency")},
}
#: Paths that may be made later: their absence is a warning.
PATHS = {"training": ("train_data", "val_data", "tokenizer_path"), "model": ("tokenizer_path",), "tokenizer": ()}


def lookup(config: Mapping[str, Any], key: str) -> Any:
    """The value at a dotted key; KeyError names the whole key."""
    at: Any = config
    for part in key.split("."):
        if not isinstance(at, Mapping) or part not in at:
            raise KeyError(key)
        at = at[part]
    return at


def problems(config: Mapping[str, Any], kind: str) -> list[str]:
    """Everything that is wrong with a configuration of the kind, in the order of its rules."""
    out = []
    for key, (must, test) in RULES[kind].items():
        try:
            value = lookup(config, key)
        except KeyError:
            out.append(f"{key} is missing")
            continue
        try:
            fine = test(value)
        except TypeError:
            fine = False
        if not fine:
            out.append(f"{key} must be {must}, not {value!r}")
    if kind == "model" and not out:
        if config["n_heads_q"] * config["head_dim"] != config["d_model"]:
            out.append("n_heads_q * head_dim must be d_model")
        if config["n_heads_q"] % config["n_heads_kv"]:
            out.append("n_heads_q must be a multiple of n_heads_kv")
    if kind == "training":
        resume = config.get("resume_from")
        if resume is not None and resume.lower() != "latest" and not os.path.exists(resume):
            out.append(f"resume_from {resume!r} does not exist")
    return out


def load(path: str, kind: str) -> dict[str, Any]:
    """The configuration in a YAML file; ValueError lists all that is wrong with it."""
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f) or {}
    wrong = problems(config, kind)
    if wrong:
        raise ValueError(f"{path}: " + "; ".join(wrong))
    for key in PATHS[kind]:
        if config.get(key) and not os.path.exists(config[key]):
            log.warning("%s: %s %r does not exist yet", path, key, config[key])
    return config


def tokens_per_step(config: Mapping[str, Any], context: int) -> int:
    return config["micro_batch_size"] * config["grad_accum_steps"] * context


def total_steps(config: Mapping[str, Any], context: int) -> int:
    return config["max_tokens"] // tokens_per_step(config, context)


def gqa(config: Mapping[str, Any]) -> dict[str, int]:
    """Query heads that share a key-value head, and the width of the keys."""
    return {"group_size": config["n_heads_q"] // config["n_heads_kv"], "kv_dim": config["n_heads_kv"] * config["head_dim"]}


def parameter_count(config: Mapping[str, Any]) -> int:
    """Parameters of a decoder with tied head: embedding, and per layer attention, gated feed-forward and two norms, and the last norm."""
    d, kv, f = config["d_model"], gqa(config)["kv_dim"], config["d_ffn"]
    q = config["n_heads_q"] * config["head_dim"]
    return config["vocab_size"] * d + config["n_layer"] * (d * q + 2 * d * kv + q * d + 3 * d * f + 2 * d) + d
