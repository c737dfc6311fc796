"""Every operator as a query on the test tables, with independent SQL for the same result."""


def load():
    """Import every module that registers queries and return the registry."""
    from importlib import import_module
    from importlib.util import find_spec

    for name in ("ingest", "filters", "rows", "quality", "segments", "stats", "timeseries", "findings", "repair",
                 "questions", "sinks"):
        if find_spec(f"checks.{name}"):
            import_module(f"checks.{name}")
    return import_module("checks.registry")
