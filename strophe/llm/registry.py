"""The query modules of this subpackage."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES: tuple[str, ...] = ("names_queries", "overlap_queries", "lookalike_queries", "groups_queries", "documents_queries", "canonical_queries")


def query_modules() -> list[ModuleType]:
    return [importlib.import_module(f"strophe.llm.{m}") for m in MODULES]
