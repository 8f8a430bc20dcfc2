"""Predicates on the axes of a solution table."""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solweave.model import Solutions


def axis_rows(table: Solutions, axis: str, want: object) -> DataFrame | None:
    """The coordinates of ``axis`` that ``want`` selects, as (axis, i); None if it selects all.

    A string is a regular expression searched for in names; a list gives members (absent ones are ignored);
    a slice takes positions; a mapping has ``min``, ``max`` (inclusive) and ``step`` (every k-th of the
    range); anything else is one coordinate. None and an empty list select all.
    """
    if want is None or (isinstance(want, (list, tuple)) and [x for x in want if x != ""] == []):
        return None
    rows, col = table.axis(axis), F.col(axis)
    text = dict(rows.dtypes)[axis] == "string"
    if isinstance(want, slice):
        size = rows.count() if any(x is not None and x < 0 for x in (want.start, want.stop)) else None
        fix = lambda x: x + size if x is not None and x < 0 else x
        start, stop, step = fix(want.start) or 0, fix(want.stop), want.step or 1
        keep = (F.col("i") >= start) & (((F.col("i") - start) % step) == 0)
        return rows.filter(keep if stop is None else keep & (F.col("i") < stop))
    if isinstance(want, str) and text:
        return rows.filter(col.rlike(want))
    if isinstance(want, Mapping):
        keep = F.lit(True)
        if want.get("min") is not None:
            keep = keep & (col >= want["min"])
        if want.get("max") is not None:
            keep = keep & (col <= want["max"])
        rows = rows.filter(keep)
        step = int(want.get("step") or 1)
        if step > 1:
            rows = rows.withColumn("k", F.row_number().over(Window.orderBy("i")) - 1).filter(F.col("k") % step == 0).drop("k")
        return rows
    members = list(want) if isinstance(want, (list, tuple)) else [want]
    kind = dict(rows.dtypes)[axis]
    return rows.filter(col.isin([str(m) for m in members] if text else [float(m) if kind in ("double", "float") else int(m) for m in members]))


def select(table: Solutions, **wanted: object) -> Solutions:
    """Rows on the selected coordinates. Unknown axes are ignored, and a selection that selects nothing keeps all."""
    df = table.df
    for axis, want in wanted.items():
        if axis not in table.axes:
            continue
        rows = axis_rows(table, axis, want)
        if rows is not None and rows.limit(1).count():
            df = df.join(rows.select(axis), axis, "left_semi")
    return table.put(df)


#: Coordinates that are named in a predicate; more of them are joined.
MOST_NAMED = 1000


def chosen(known: np.ndarray, want: object) -> np.ndarray | None:
    """The coordinates among ``known`` (in order) that ``want`` selects, by the rules of ``axis_rows``; None if it selects all."""
    if want is None or (isinstance(want, (list, tuple)) and [x for x in want if x != ""] == []):
        return None
    text = known.dtype.kind == "U"
    if isinstance(want, slice):
        return known[want]
    if isinstance(want, str) and text:
        return known[[re.search(want, k) is not None for k in known.tolist()]]
    if isinstance(want, Mapping):
        lo, hi = want.get("min"), want.get("max")
        first = 0 if lo is None else int(np.searchsorted(known, lo, "left"))
        end = len(known) if hi is None else int(np.searchsorted(known, hi, "right"))
        return known[first:end][:: int(want.get("step") or 1)]
    members = list(want) if isinstance(want, (list, tuple)) else [want]
    return known[np.isin(known, np.array([str(m) for m in members] if text else [float(m) for m in members]))]


def pick(table: Solutions, axis: str, known: np.ndarray, want: object) -> Solutions:
    """Rows on the selected coordinates of an axis whose coordinates are known, as a predicate on the rows; a selection that selects nothing keeps all."""
    got = chosen(known, want)
    if got is None or not len(got) or len(got) == len(known) or axis not in table.axes:
        return table
    first = int(np.searchsorted(known, got[0]))
    ends = got[[0, -1]].tolist()
    if np.array_equal(known[first : first + len(got)], got):  # a stretch of the axis
        return table.put(table.df.filter(F.col(axis).between(*ends) if len(got) > 1 else F.col(axis) == ends[0]))
    if len(got) <= MOST_NAMED:
        return table.put(table.df.filter(F.col(axis).isin(got.tolist())))
    kind = dict(table.df.dtypes)[axis]
    return table.put(table.df.join(table.df.sparkSession.createDataFrame([(g,) for g in got.tolist()], f"`{axis}` {kind}"), axis, "left_semi"))


def set_axis_values(table: Solutions, axis: str, new: Mapping[object, object]) -> Solutions:
    """Other names for coordinates; those that aren't listed stay."""
    kind = dict(table.df.dtypes)[axis]
    given = F.create_map(*[F.lit(x) for kv in new.items() for x in kv])
    return table.put(table.df.withColumn(axis, F.coalesce(given[F.col(axis)], F.col(axis)).cast(kind)))


def set_values(table: Solutions, new: DataFrame, column: str = "val") -> Solutions:
    """Replace ``val`` or ``weight`` by that of ``new`` where its axis columns match."""
    if column not in ("val", "weight"):
        raise ValueError("val or weight")
    on = [a for a in table.axes if a in new.columns]
    given = new.select(*on, F.col(column).cast("double").alias("__new"), F.lit(True).alias("__hit"))
    x = table.df.join(given, on, "left")
    return table.put(x.withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))))
