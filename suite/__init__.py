"""Registered queries: each operator on the given tables, with its SQL equivalent."""

from importlib import import_module

MODULES = ("comparing", "copies", "files", "loading", "searching", "jobs")


def _load():
    for name in MODULES:
        import_module(f"suite.{name}")
    from suite import registry
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
