"""All queries of the core engine."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package with a registry ``REG``.
MODULES = ["hierarchies", "scalars", "retrieval", "graph", "relational", "planes", "sources", "entity_plane", "upkeep"]


def registries() -> list:
    return [import_module(f"lodestitch.queries.{m}").REG for m in MODULES]
