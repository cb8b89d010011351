"""Every query of the evaluation engine by name, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLE_SQL, QUERIES

for _module in ("cells", "construct", "text", "classify", "agreement", "resample", "models", "sources", "records", "failures", "release", "panels", "files", "requests"):
    import_module(f"{__package__}.{_module}_queries")

__all__ = ["ORACLE_SQL", "QUERIES"]
