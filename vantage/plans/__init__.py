"""Queries that apply the operators to the driver's tables."""

import importlib

AREAS = ("metrics", "event_log", "commerce", "corpus", "streams", "records", "keyed_streams", "timed_streams", "evidence", "claims", "blocks")


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"vantage.plans.{area}")
