"""Operators for preparing training text: near-duplicates, filters, scans, scores, formatting and packing.

Importing the package registers one query for each operator.
"""

import importlib

from chartspark.llm.registry import QUERIES, SQL

MODULES = [
    "simhash", "lattice", "packing", "chat", "secrets", "toxicity", "personal", "decontamination", "passages", "neighbours",
    "exact", "middle", "resampling",
]

for _module in MODULES:
    importlib.import_module(f"chartspark.llm.{_module}")

__all__ = ["QUERIES", "SQL"]
