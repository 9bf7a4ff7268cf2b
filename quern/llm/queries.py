"""The queries of the training-data operators, by name; ``sql()`` has those that SQL can express."""

from __future__ import annotations

import importlib

#: Modules that define QUERIES (name -> callable) and perhaps SQL (name -> text).
MODULES = ("q_neardup", "q_origin", "q_leak", "q_parse", "q_mixture", "q_secrets", "q_encode", "q_pack", "q_sentences")


def _modules():
    for name in MODULES:
        yield importlib.import_module(f"quern.llm.{name}")


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out.update(getattr(m, "SQL", {}))
    return out
