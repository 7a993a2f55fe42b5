"""Registered queries on the test tables, each with the SQL that must give the same rows."""

from sitepanel.catalog import analyses, climate, figures, models, panels, rows  # noqa: F401
from sitepanel.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
