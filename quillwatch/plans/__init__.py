"""Registered queries, grouped by area."""

import importlib

AREAS = ["scans", "normalization", "filtering", "detection", "analysis", "governance", "streams"]


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"quillwatch.plans.{area}")
