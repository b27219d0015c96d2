"""Registered queries: every operator applied to the driver's tables, with its DuckDB equivalent."""

from . import events, files, graphs, runs
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "events", "files", "graphs", "runs"]
