"""Registered queries over the fixture views."""

from __future__ import annotations

import importlib

AREAS = ("series", "walks", "catalog", "state", "matching", "vector", "labels", "cutlists", "curves", "transfer", "live")


def all_queries():
    """All registered queries by name."""
    for area in AREAS:
        importlib.import_module(f"cadenza.plans.{area}_queries")
    from cadenza.plans.registry import REGISTRY

    return REGISTRY
