"""Named queries over the evaluation tables."""

from __future__ import annotations

import importlib

from tallyloom.plans.registry import Catalogue

MODULES = ["nested", "aggregates", "scores", "relational", "answers", "tasks", "streams"]


def catalogues() -> list[Catalogue]:
    return [importlib.import_module(f"tallyloom.plans.{m}").catalogue for m in MODULES]
