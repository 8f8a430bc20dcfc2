"""Solution files in HDF5: read slab by slab on the executors, written slab by slab from the driver. Needs h5py where it is used."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import closing
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from solweave.model import KINDS, Solutions

#: Cells that a task reads at a time.
SLAB = 1_000_000
FORMAT = "1.0"


def open_hdf5(path: str, mode: str = "r"):
    """The file; a clear error where h5py isn't installed."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading and writing HDF5 needs h5py") from e
    return h5py.File(path, mode)


def _text(x: object) -> str:
    return x.decode() if isinstance(x, bytes) else str(x)


def _plain(values: np.ndarray) -> list:
    return [_text(v) for v in values.tolist()] if values.dtype.kind in "SUO" else values.tolist()


def contents(path: str, opener: Callable[..., Mapping] = open_hdf5) -> dict[str, list[str]]:
    """The solution sets of a file and the names of their tables."""
    with closing(opener(path)) as f:
        return {s: sorted(t for t in f[s] if hasattr(f[s][t], "keys") and "val" in f[s][t]) for s in sorted(f)}


def read_side(spark: SparkSession, path: str, solset: str, side: str, opener: Callable[..., Mapping] = open_hdf5) -> DataFrame | None:
    """The ``antenna`` (name, position) or ``source`` (name, dir) table of a set; None where there is none."""
    vec = "position" if side == "antenna" else "dir"
    with closing(opener(path)) as f:
        if side not in f[solset]:
            return None
        rows = f[solset][side][...]
    return spark.createDataFrame([(_text(r["name"]), [float(v) for v in r[vec]]) for r in rows], f"name string, {vec} array<float>")


def read_table(spark: SparkSession, path: str, address: str, opener: Callable[..., Mapping] = open_hdf5) -> Solutions:
    """The table ``solset/soltab`` in long form, with the ordinals of its coordinates.

    The driver reads the axes; the values are read by the tasks, each its slabs of the first axis, from a path that all executors reach. NaN
    becomes null. A table of a kind that isn't known, or without axes, is refused.
    """
    solset, _, name = address.partition("/")
    with closing(opener(path)) as f:
        group = f[solset][name]
        axes = [a.strip() for a in _text(group["val"].attrs["AXES"]).split(",") if a.strip()]
        kind = _text(group.attrs["TITLE"])
        shape = tuple(int(n) for n in group["val"].shape)
        coords = {a: np.asarray(group[a][...]) for a in axes}
        attrs = {str(k): _text(v) for k, v in group.attrs.items() if k != "TITLE"}
    if kind not in KINDS or not axes or shape != tuple(len(coords[a]) for a in axes):
        raise ValueError(f"{address}: kind {kind}, axes {axes}, shape {shape}")
    plain = {a: _plain(c) for a, c in coords.items()}
    types = {a: "string" if isinstance(p[0] if p else 0.0, str) else "double" if coords[a].dtype.kind == "f" else "bigint" for a, p in plain.items()}
    thick = max(1, SLAB // max(1, int(np.prod(shape[1:]))))
    slabs = max(1, -(-shape[0] // thick))
    schema = ", ".join(f"`{a}` {types[a]}, `{a}__i` int" for a in axes) + ", val double, weight double"
    df = spark.range(0, slabs, 1, min(slabs, 10_000)).mapInArrow(_slabs(path, solset, name, axes, plain, shape, thick, opener), schema)
    return Solutions.of(df, axes, kind, name).put(Solutions.of(df, axes, kind, name).df, attrs=attrs)


def _slabs(path, solset, name, axes, plain, shape, thick, opener) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(opener(path)) as f:
            group = f[solset][name]
            for b in batches:
                for k in b["id"].to_pylist():
                    lo, hi = k * thick, min((k + 1) * thick, shape[0])
                    val = np.asarray(group["val"][lo:hi], dtype=float)
                    weight = np.asarray(group["weight"][lo:hi], dtype=float) if "weight" in group else np.ones(val.shape)
                    at = [i.ravel() for i in np.indices(val.shape)]
                    at[0] = at[0] + lo
                    cols, names = [], []
                    for a, i in zip(axes, at, strict=True):
                        cols += [pa.array(plain[a]).take(pa.array(i)), pa.array(i.astype(np.int32))]
                        names += [a, f"{a}__i"]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(val.ravel(), from_pandas=True), pa.array(weight.ravel())], names=[*names, "val", "weight"])

    return run


def write_table(path: str, solset: str, table: Solutions, antennas: DataFrame | None = None, sources: DataFrame | None = None, opener: Callable[..., Mapping] = partial(open_hdf5, mode="a")) -> None:
    """Add a table to a file (created if needed), missing cells as NaN with weight 0, and the side tables if given.

    The driver holds one coordinate of the first axis at a time. A table of the same name is refused.
    """
    axes = list(table.axes)
    coords = {a: table.axis_values(a) for a in axes}
    with closing(opener(path)) as f:
        group = f.require_group(solset)
        group.attrs["h5parm_version"] = FORMAT
        for side, df, vec, size in (("antenna", antennas, "position", 3), ("source", sources, "dir", 2)):
            if df is not None and side not in group:
                rows = df.dropna(subset=["name"]).dropDuplicates(["name"]).orderBy("name").collect()  # an array's stations, or its directions
                kind = np.dtype([("name", "S128"), (vec, np.float32, (size,))])
                group.create_dataset(side, data=np.array([(r.name.encode(), r[vec] if r[vec] is not None else [np.nan] * size) for r in rows], dtype=kind))
        if table.name in group:
            raise FileExistsError(f"{solset}/{table.name}")
        out = group.create_group(table.name)
        out.attrs["TITLE"] = table.kind
        for k, v in table.attrs.items():
            out.attrs[k] = v
        shape = tuple(len(coords[a]) for a in axes)
        stored = {n: out.create_dataset(n, shape=shape, dtype="f8") for n in ("val", "weight")}
        for n in stored:
            stored[n].attrs["AXES"] = ",".join(axes)
            stored[n][...] = np.nan if n == "val" else 0.0
        for a, c in coords.items():
            out.create_dataset(a, data=np.array([v.encode() for v in c] if c and isinstance(c[0], str) else c))
        place = {v: i for i, v in enumerate(coords[axes[0]])}
        for at, val, weight in table.grids(axes[1:]):
            stored["val"][place[at[axes[0]]]] = val
            stored["weight"][place[at[axes[0]]]] = weight
