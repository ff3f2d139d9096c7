"""Registered queries, one module per family."""

from importlib import import_module

MODULES = ["floods", "climate", "models", "water", "alerts", "features", "spatial", "sources", "streams", "learn"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"raincourse.plans.{name}")
