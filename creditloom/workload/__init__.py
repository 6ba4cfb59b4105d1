"""Registered queries: importing the modules fills the registry."""

import importlib

from creditloom.workload.base import ORACLES, QUERIES

MODULES = ("history", "joins", "features", "prep", "ranking", "diagnostics", "ingest", "models", "jobs", "fitted")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"creditloom.workload.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
