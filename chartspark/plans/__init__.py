"""Registered queries. Importing this package fills the catalogue."""

import importlib

from chartspark.plans.registry import QUERIES, SQL

MODULES = ["evaluation", "text", "gallery", "sequences", "bundle", "charts", "tables", "validation", "mapping", "scoring", "files", "streams"]

for _module in MODULES:
    importlib.import_module(f"chartspark.plans.{_module}")

__all__ = ["QUERIES", "SQL"]
