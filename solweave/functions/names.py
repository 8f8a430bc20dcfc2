"""Spelling rules for names in delivered tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def station(col: Column | str) -> Column:
    """A station name without regard to letter case and surrounding blanks; null stays null."""
    return F.upper(F.trim(F.col(col) if isinstance(col, str) else col))


def label(col: Column | str) -> Column:
    """A source or language label without regard to letter case and surrounding blanks."""
    return F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
