"""Queries by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import flows, relational, textual, upkeep


def queries() -> dict:
    return relational.QUERIES | textual.QUERIES | upkeep.QUERIES | flows.QUERIES


def oracle_sql() -> dict:
    return relational.ORACLE | textual.ORACLE | upkeep.ORACLE | flows.ORACLE
