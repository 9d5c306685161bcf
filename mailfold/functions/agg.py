"""Aggregate helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def ordered_listagg(value: str, sep: str, *order: str) -> Column:
    """``listagg(value, sep) WITHIN GROUP (ORDER BY ...)`` on named columns.

    Only used on groups with a bounded size (a page of mail, one briefing
    section, one conversation), never on an unbounded key.
    """
    keys = ", ".join(o if " " in o else f"`{o}`" for o in order)
    return F.expr(f"listagg(`{value}`, {_sql_str(sep)}) WITHIN GROUP (ORDER BY {keys})")
