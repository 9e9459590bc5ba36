"""Named queries over the provided tables, each with SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from msgrisk.catalog.registry import ORACLE, QUERIES

for _area in ("corpus", "metrics", "evaluation", "text", "history", "pages", "sender", "messages", "mail", "posture",
              "reviews", "terms", "threads", "build", "cases"):
    try:
        import_module(f"msgrisk.catalog.{_area}")
    except ModuleNotFoundError as missing:  # pragma: no cover - only while an area is absent
        if missing.name != f"msgrisk.catalog.{_area}":
            raise

__all__ = ["ORACLE", "QUERIES"]
