"""All queries of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ["queries"]


def registries() -> list:
    return [import_module(f"lodestitch.llm.{m}").REG for m in MODULES]
