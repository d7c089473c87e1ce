"""Registered queries: operators applied to whole tables."""

from importlib import import_module

MODULES = ("stamping", "visibility", "market", "intraday", "screening", "performance", "reconcile", "audits", "corpus", "trading", "storage")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
