"""All queries by name: (callable, oracle SQL or None)."""

from __future__ import annotations

import importlib

from haulmark.plans.register import QUERIES

for _name in ("overview", "mileage", "episodes", "ingest", "reconcile", "operations", "streams", "history", "raw_layer", "fleet", "client", "landed", "scalars", "applied", "live", "harvest", "purged", "moved", "dashboards", "audits"):
    importlib.import_module(f"haulmark.plans.{_name}")

__all__ = ["QUERIES"]
