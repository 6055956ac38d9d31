"""Registered queries, one module per operator family."""

import importlib

MODULES = ("events", "funnel", "tables", "features", "sqlviews", "recall", "ranking", "models", "quality", "io")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"wayfunnel.plans.{name}")
