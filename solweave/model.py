"""Solution tables: labelled grids in long form."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("amplitude", "phase", "scalarphase", "scalaramplitude", "rotation", "rotationmeasure", "clock", "tec", "tec3rd", "tecscreen", "phase_offset")


@dataclass(frozen=True)
class Solutions:
    """One row per grid cell: a column per axis, ``val`` and ``weight``. Weight 0 means flagged; NaN values are null.

    Operators return new tables and never change one. An axis may have an ordinal column ``<axis>__i``; where
    it is missing, the ordinals follow the sorted coordinates.
    """

    df: DataFrame
    axes: tuple[str, ...]
    kind: str = "amplitude"
    name: str = "amplitude000"
    attrs: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(df: DataFrame, axes: Sequence[str], kind: str = "amplitude", name: str | None = None) -> Solutions:
        """A table from rows: NaN becomes null, a missing weight 0, and a missing weight column 1."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        for a in axes:
            if a not in df.columns:
                raise ValueError(f"axis {a} has no column")
        v = F.col("val").cast("double")
        w = F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) if "weight" in df.columns else F.lit(1.0)
        ordinals = [f"{a}__i" for a in axes if f"{a}__i" in df.columns]
        return Solutions(df.select(*axes, *ordinals, F.when(~F.isnan(v), v).alias("val"), w.alias("weight")), tuple(axes), kind, name or f"{kind}000")

    @property
    def is_phase(self) -> bool:
        return self.kind in ("phase", "scalarphase", "rotation", "phase_offset")

    @property
    def is_amplitude(self) -> bool:
        return self.kind in ("amplitude", "scalaramplitude")

    @property
    def default(self) -> float:
        return 1.0 if self.is_amplitude else 0.0

    def others(self, axes: Sequence[str]) -> list[str]:
        """The axes that aren't in ``axes``; an unknown one is refused."""
        for a in axes:
            if a not in self.axes:
                raise ValueError(f"{self.name} has no axis {a}")
        return [a for a in self.axes if a not in axes]

    def put(self, df: DataFrame, **changes: object) -> Solutions:
        axes = changes.get("axes", self.axes)
        keep = [*axes, *[f"{a}__i" for a in axes if f"{a}__i" in df.columns], "val", "weight"]
        return replace(self, df=df.select(*keep), **changes)

    def axis(self, name: str) -> DataFrame:
        """The coordinates of an axis and their ordinals ``i``. An axis is short; it is ranked in one task."""
        if f"{name}__i" in self.df.columns:
            return self.df.groupBy(name).agg(F.min(f"{name}__i").alias("i"))
        return self.df.select(name).distinct().withColumn("i", (F.row_number().over(Window.orderBy(name)) - 1).cast("int"))

    def axis_values(self, name: str, most: int = 1_000_000) -> list:
        """The coordinates of an axis in order; more than ``most`` are refused."""
        if name not in self.axes:
            raise ValueError(f"{self.name} has no axis {name}")
        rows = self.axis(name).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"axis {name} has more than {most} coordinates")
        return [r[name] for r in sorted(rows, key=lambda r: r.i)]

    def axis_length(self, name: str) -> int:
        return self.df.select(name).distinct().count()

    def axis_type(self, name: str) -> str:
        return dict(self.df.dtypes)[name]

    def __getattr__(self, name: str) -> list:
        """``table.time`` gives the coordinates of the axis ``time``."""
        if name.startswith("_") or name not in self.__dict__.get("axes", ()):
            raise AttributeError(name)
        return self.axis_values(name)

    def grids(self, axes: Sequence[str]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
        """For each combination of the other coordinates these, and the values and weights on the grid of ``axes`` (in the table's order): missing cells are NaN with weight 0.

        A group's cells are brought together by the cluster, and the driver holds one group at a time.
        """
        inner = [a for a in self.axes if a in axes]
        keys = self.others(inner)
        coords = {a: self.axis_values(a) for a in inner}
        place = {a: {v: i for i, v in enumerate(c)} for a, c in coords.items()}
        cell = F.struct(*inner, F.col("val").cast("double").alias("val"), F.col("weight").cast("double").alias("weight"))
        groups = self.df.groupBy(*keys).agg(F.collect_list(cell).alias("cells"))
        for row in groups.orderBy(*keys).toLocalIterator() if keys else groups.toLocalIterator():
            shape = [len(coords[a]) for a in inner]
            val, weight = np.full(shape, np.nan), np.zeros(shape)
            for c in row.cells:
                at = tuple(place[a][c[a]] for a in inner)
                val[at], weight[at] = np.nan if c.val is None else c.val, c.weight or 0.0
            yield {k: row[k] for k in keys} | coords, val, weight

    def fully_flagged(self, axis: str = "ant") -> DataFrame:
        """Coordinates at which every weight is 0."""
        return self.df.groupBy(axis).agg(F.max(F.abs("weight")).alias("w")).filter(F.col("w") == 0).select(axis)

    def densify(self) -> Solutions:
        """All combinations of the coordinates; cells that were missing get a null value and weight 0."""
        grid = None
        for a in self.axes:
            col = self.df.select(a).distinct()
            grid = col if grid is None else grid.join(col, how="cross")  # the grid is the product; the planner weighs the sides
        plain = self.df.select(*self.axes, "val", "weight")
        full = grid.join(plain, list(self.axes), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        return self.put(full)

    def reorder(self, *axes: str) -> Solutions:
        """Another order of the axes: rows in long form stay as they are."""
        if sorted(axes) != sorted(self.axes):
            raise ValueError("name each axis once")
        return replace(self, axes=tuple(axes))


def good() -> Column:
    """The value where it isn't flagged."""
    return F.when(F.col("weight") != 0, F.col("val"))


def with_stats(df: DataFrame, keys: Sequence[str], stats: DataFrame) -> DataFrame:
    """Join group figures back to rows; without keys there is a single row of figures."""
    return df.join(stats, list(keys)) if keys else df.join(F.broadcast(stats.limit(1)), how="cross")
