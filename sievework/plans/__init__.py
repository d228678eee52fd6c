"""Queries over the given tables, grouped by subject."""

from __future__ import annotations

from importlib import import_module

from sievework.plans.catalogue import QUERIES, Query

SUBJECTS = ["classification", "counts", "profiles", "samples", "duplicate_groups", "reviews", "reruns", "evaluation",
            "probes"]


def all_queries() -> dict[str, Query]:
    for subject in SUBJECTS:
        import_module(f"sievework.plans.{subject}")
    return dict(QUERIES)
