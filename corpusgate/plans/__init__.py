"""All registered queries."""

from __future__ import annotations

import importlib

from corpusgate.plans.base import REGISTRY, Query

_MODULES = ("texts", "checks", "joins", "topic", "claim", "changes", "pages", "tracking",
            "streams", "files")


def registry() -> dict[str, Query]:
    for name in _MODULES:
        importlib.import_module(f"corpusgate.plans.{name}")
    return dict(REGISTRY)
