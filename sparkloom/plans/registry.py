"""Imports every query module, so that the catalog is full."""

from . import q_audits, q_decide, q_evidence, q_flow, q_pages, q_signals, q_tables  # noqa: F401
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
