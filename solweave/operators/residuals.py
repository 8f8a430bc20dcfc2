"""Differences between tables, with models of what one kind of solution does to another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from solweave.functions.scalar import phase_model
from solweave.model import Solutions


def residuals(table: Solutions, subtract: Sequence[Solutions], ratio: bool = False) -> Solutions:
    """Subtract tables (on the same or fewer axes) one after another.

    A table of the same kind is subtracted as it is (with ``ratio`` also divided by). Clock, TEC, third-order TEC
    and rotation-measure tables are turned into the phase they cause at the cell's frequency; a rotation measure has the
    opposite sign on the first of two circular (or linear) polarisations, and rotates a table of rotations. Cells that are flagged, null or missing in
    a subtracted table become flagged.
    """
    out = table
    for sub in subtract:
        if any(a not in table.axes for a in sub.axes):
            raise ValueError(f"{sub.name} has axes that {table.name} lacks")
        same = sub.kind == table.kind
        if not same and not (table.is_phase and sub.kind in ("clock", "tec", "tec3rd", "rotationmeasure", "phase", "scalarphase")):
            raise ValueError(f"can't subtract {sub.kind} from {table.kind}")
        given = sub.df.select(*sub.axes, F.col("val").alias("__v"), F.col("weight").alias("__w"))
        df = out.df.join(given, list(sub.axes), "left")
        if same or sub.kind in ("phase", "scalarphase"):
            model = F.col("__v")
        else:
            if "freq" not in table.axes:
                raise ValueError("the model needs frequencies")
            first = None
            if sub.kind == "rotationmeasure" and table.kind != "rotation":
                first = F.col("pol").isin("XX", "RR")
            model = phase_model(sub.kind, F.col("__v"), F.col("freq").cast("double"), first)
        diff = F.col("val") - model
        new = F.try_divide(diff, model) if ratio and same else diff
        lost = F.col("__w").isNull() | (F.col("__w") == 0) | F.col("__v").isNull()
        out = out.put(df.withColumn("val", new).withColumn("weight", F.when(lost, 0.0).otherwise(F.col("weight"))))
    return out
