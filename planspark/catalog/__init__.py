"""The named queries over the driver tables."""

from __future__ import annotations

import importlib

from planspark.catalog.registry import QUERIES, SQL

MODULES = (
    "scalars",
    "texts",
    "tasklog",
    "corpora",
    "doors",
    "detections",
    "lines",
    "plans",
    "cycles",
    "symbols",
    "rasters",
    "formats",
)


def load():
    """All registered queries and their SQL twins."""
    for module in MODULES:
        importlib.import_module(f"planspark.catalog.{module}")
    return QUERIES, SQL
