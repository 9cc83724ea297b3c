"""Queries over the driver's tables and the SQL they are compared with."""


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for name in ("normalize", "scoring", "blocks", "reporting", "curation", "exchange", "streams"):
        importlib.import_module(f"checks.{name}")
