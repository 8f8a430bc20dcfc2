"""A store of solution sets: Parquet tables, side tables and history under one folder."""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from solweave.model import Solutions
from solweave.operators.selection import pick, select

VERSION = "1.0"
_NAME = re.compile(r"^[A-Za-z0-9_-]+$")

#: Coordinates of an axis that are kept beside the table; those of a longer axis are looked up in the table.
MOST_COORDINATES = 1_000_000


class Store:
    """``root/<solset>/<table>/v-<id>`` holds the rows of a table, ``table.json`` beside it names the current version.

    A write goes to a new version and is switched to when it is complete, so a table may be read while it is
    rewritten from itself; the version before is kept until the next write. ``mode``: ``r`` reads, ``a`` also writes and creates.

    Beside the rows stand the coordinates of each axis and the numbers of cells and of flagged ones, so selections become plain predicates on one scan
    and reports read no rows. Rows are laid out by ranges of the leading axes, so these predicates pass over files and row groups.
    """

    def __init__(self, spark: SparkSession, root: str, mode: str = "r") -> None:
        if mode not in ("r", "a"):
            raise ValueError("mode is r or a")
        self.spark, self.root, self.mode = spark, root.rstrip("/"), mode
        self._seen: dict[str, dict] = {}
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path(self.root)):
            if mode == "r":
                raise FileNotFoundError(root)
            self._fs.mkdirs(self._path(self.root))
            self._put("store.json", {"version": VERSION})
        elif self._get("store.json").get("version") != VERSION:
            raise ValueError(f"{root} isn't a store of version {VERSION}")

    # files -----------------------------------------------------------------------------------------
    def _at(self, *parts: str):
        return self._path("/".join([self.root, *parts]))

    def _put(self, name: str, content: dict) -> None:
        if self.mode != "a":
            raise PermissionError("the store is open for reading")
        tmp = self._at(f"{name}.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._fs.exists(self._at(name)):
            self._fs.delete(self._at(name), False)
        self._fs.rename(tmp, self._at(name))

    def _get(self, name: str) -> dict:
        if not self._fs.exists(self._at(name)):
            return {}
        stream = self._fs.open(self._at(name))
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return json.loads(text)

    def _dirs(self, *parts: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(*parts)) if s.isDirectory())

    def _delete(self, *parts: str) -> None:
        if self.mode != "a":
            raise PermissionError("the store is open for reading")
        self._fs.delete(self._at(*parts), True)

    # solution sets -----------------------------------------------------------------------------------
    def solsets(self, pattern: str = "") -> list[str]:
        return [s for s in self._dirs() if re.search(pattern, s)]

    def make_solset(self, name: str | None = None, antennas: DataFrame | None = None, sources: DataFrame | None = None) -> str:
        """Create a set; without a valid free name it gets the lowest free ``solNNN``."""
        have = set(self._dirs())
        if not name or not _NAME.match(name) or name in have:
            name = next(f"sol{i:03d}" for i in range(10**6) if f"sol{i:03d}" not in have)
        self._fs.mkdirs(self._at(name))
        self._put(f"{name}/solset.json", {"version": VERSION})
        for side, df in (("antenna", antennas), ("source", sources)):
            if df is not None:
                self.write_side(name, side, df)
        return name

    def _need(self, solset: str) -> None:
        if solset not in self._dirs():
            raise KeyError(f"no solution set {solset}")

    def delete_solset(self, name: str) -> None:
        self._need(name)
        self._delete(name)

    def rename_solset(self, old: str, new: str, overwrite: bool = False) -> None:
        self._need(old)
        if new in self._dirs():
            if not overwrite:
                raise FileExistsError(new)
            self._delete(new)
        self._fs.rename(self._at(old), self._at(new))

    def copy_solset(self, name: str, to: Store, new: str | None = None) -> str:
        """A copy in another store (or this one), where the name must be free."""
        new = new or name
        if new in to._dirs():
            raise FileExistsError(new)
        to.make_solset(new, self.side(name, "antenna"), self.side(name, "source"))
        for t in self.tables(name):
            to.write(new, self.table(f"{name}/{t}"))
            meta = to._meta(f"{new}/{t}") | {"history": [*self._meta(f"{name}/{t}").get("history", []), self._dated(f"copied from {name}/{t}")]}
            to._put(f"{new}/{t}/table.json", meta)
        return new

    def write_side(self, solset: str, side: str, df: DataFrame) -> None:
        if side not in ("antenna", "source"):
            raise ValueError("antenna or source")
        vec = "position" if side == "antenna" else "dir"
        df.select(F.col("name").cast("string"), F.col(vec).cast("array<float>")).write.mode("overwrite").parquet(f"{self.root}/{solset}/_{side}")

    def side(self, solset: str, side: str) -> DataFrame | None:
        """The antenna or source table; None where there is none."""
        return self.spark.read.parquet(f"{self.root}/{solset}/_{side}") if self._fs.exists(self._at(solset, f"_{side}")) else None

    # tables ------------------------------------------------------------------------------------------
    def tables(self, solset: str) -> list[str]:
        self._need(solset)
        return [t for t in self._dirs(solset) if not t.startswith("_")]

    def free_name(self, solset: str, kind: str, name: str | None = None) -> str:
        have = set(self.tables(solset))
        if name and _NAME.match(name) and name not in have:
            return name
        return next(f"{kind}{i:03d}" for i in range(10**6) if f"{kind}{i:03d}" not in have)

    def make_table(self, solset: str, df: DataFrame, axes: Sequence[str], kind: str, name: str | None = None, dense: bool = False) -> Solutions:
        """Store new rows under a free name. Coordinates must be unique; with ``dense`` missing cells are added, flagged."""
        t = Solutions.of(df, axes, kind)
        twice = t.df.groupBy(*axes).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        if twice.limit(1).count():
            raise ValueError("coordinates occur twice")
        t = t.put((t.densify() if dense else t).df, name=self.free_name(solset, kind, name))
        self.write(solset, t, note="created")
        return self.table(f"{solset}/{t.name}")

    def write(self, solset: str, table: Solutions, note: str = "") -> None:
        """Write a table under its name, in place of what is there."""
        self._need(solset)
        version = f"v-{uuid.uuid4().hex}"
        old = self._get(f"{solset}/{table.name}/table.json")
        path = f"{self.root}/{solset}/{table.name}/{version}"
        df, axes, seen = table.df, list(table.axes), Observation()
        if axes:
            df = df.repartitionByRange(*axes[:2]).sortWithinPartitions(*axes)
        bad = (F.col("weight") == 0) | F.col("val").isNull()
        df.observe(seen, F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum(bad.cast("bigint")), F.lit(0)).alias("flagged")).write.parquet(path)
        meta = {"kind": table.kind, "axes": axes, "attrs": table.attrs, "version": version, "previous": old.get("version"), "history": old.get("history", []), **seen.get}
        known, meta["lengths"] = self._axes(self.spark.read.schema(table.df.schema).parquet(path), axes)
        packed = io.BytesIO()
        np.savez(packed, **known)
        out = self._fs.create(self._path(f"{path}/_coordinates.npz"), True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        if note:
            meta["history"] = [*meta["history"], self._dated(note)]
        self._put(f"{solset}/{table.name}/table.json", meta)
        if old.get("previous"):  # the last version but one; plans made before this write may still read the last
            self._delete(solset, table.name, old["previous"])

    def _axes(self, df: DataFrame, axes: Sequence[str]) -> tuple[dict[str, np.ndarray], dict[str, int]]:
        """The coordinates of each axis in order, and its length, in one job. Axes of more than ``MOST_COORDINATES`` or of other types than text and numbers are left out."""
        kinds, parts = dict(df.dtypes), None
        real, whole, text = ("double", "float"), ("int", "bigint", "smallint", "tinyint"), ("string",)
        kept = [a for a in axes if kinds[a] in (*real, *whole, *text)]
        for a in kept:
            x = df.select(a).filter(F.col(a).isNotNull()).distinct().limit(MOST_COORDINATES + 1)
            cols = [F.col(a).cast(t).alias(n) if kinds[a] in k else F.lit(None).cast(t).alias(n) for n, t, k in (("real", "double", real), ("whole", "bigint", whole), ("text", "string", text))]
            one = x.select(F.lit(a).alias("axis"), *cols)
            parts = one if parts is None else parts.unionByName(one)
        known: dict[str, np.ndarray] = {}
        if parts is not None:
            got = parts.toArrow()
            names = np.array(got["axis"].to_pylist(), dtype=str)
            for a in kept:
                col = "text" if kinds[a] in text else "real" if kinds[a] in real else "whole"
                values = got[col].filter(pa.array(names == a))
                known[a] = np.sort(np.array(values.to_pylist(), dtype=str) if col == "text" else values.to_numpy())
        short = {a: c for a, c in known.items() if len(c) <= MOST_COORDINATES}
        lengths = {a: len(short[a]) if a in short else df.select(a).distinct().count() for a in axes}
        return short, lengths

    def _known(self, solset: str, name: str, meta: dict) -> dict[str, np.ndarray]:
        """The stored coordinates of a version; a version never changes, so they are read once."""
        path = f"{self.root}/{solset}/{name}/{meta['version']}"
        got = self._seen.setdefault(path, {})
        if "axes" not in got:
            stream = self._fs.open(self._path(f"{path}/_coordinates.npz"))
            with np.load(io.BytesIO(bytes(stream.readAllBytes()))) as z:
                got["axes"] = {a: z[a] for a in z.files}
            stream.close()
        return got["axes"]

    def _meta(self, address: str) -> dict:
        solset, _, name = address.partition("/")
        meta = self._get(f"{solset}/{name}/table.json")
        if not meta:
            self._need(solset)
            raise KeyError(f"no table {address}")
        return meta

    def coordinates(self, address: str, axis: str) -> list:
        """The coordinates of an axis, in order."""
        solset, _, name = address.partition("/")
        known = self._known(solset, name, self._meta(address))
        return known[axis].tolist() if axis in known else [r[0] for r in self.table(address).axis(axis).orderBy("i").collect()]

    def table(self, address: str, **wanted: object) -> Solutions:
        """The table at ``solset/table``, with a selection if given."""
        solset, _, name = address.partition("/")
        meta = self._meta(address)
        path = f"{self.root}/{solset}/{name}/{meta['version']}"
        if "schema" not in self._seen.setdefault(path, {}):
            self._seen[path]["schema"] = self.spark.read.parquet(path).schema  # a version never changes
        df = self.spark.read.schema(self._seen[path]["schema"]).parquet(path)
        t = Solutions(df, tuple(meta["axes"]), meta["kind"], name, meta["attrs"])
        known = self._known(solset, name, meta) if wanted else {}
        for axis in [a for a in wanted if a in known]:
            t = pick(t, axis, known[axis], wanted.pop(axis))
        return select(t, **wanted) if wanted else t

    def delete_table(self, address: str) -> None:
        solset, _, name = address.partition("/")
        if name not in self.tables(solset):
            raise KeyError(f"no table {address}")
        self._delete(solset, name)

    def rename_table(self, address: str, new: str, overwrite: bool = False) -> None:
        solset, _, name = address.partition("/")
        if name not in self.tables(solset):
            raise KeyError(f"no table {address}")
        if new in self.tables(solset):
            if not overwrite:
                raise FileExistsError(new)
            self._delete(solset, new)
        self._fs.rename(self._at(solset, name), self._at(solset, new))

    @staticmethod
    def _dated(entry: str) -> str:
        return f"{datetime.now():%Y-%m-%d %H:%M:%S}: {entry}"

    def add_history(self, solset: str, name: str, entry: str) -> None:
        meta = self._meta(f"{solset}/{name}")
        meta["history"] = [*meta.get("history", []), self._dated(entry)]
        self._put(f"{solset}/{name}/table.json", meta)

    def history(self, address: str) -> str:
        solset, _, name = address.partition("/")
        return "\n".join(self._get(f"{solset}/{name}/table.json").get("history", []))

    def info(self, pattern: str = "", verbose: bool = False) -> str:
        """A report on all tables: antennas and directions, axes and their lengths, share of flagged or null cells, history.

        ``verbose`` lists the coordinates of all axes, the positions and the attributes. Nothing is read but what stands beside the tables.
        """
        out = []
        for s in self.solsets(pattern):
            out.append(f"Solution set '{s}'")
            for side, vec in (("source", "dir"), ("antenna", "position")):
                df = self.side(s, side)
                if df is None:
                    continue
                rows = list(df.dropDuplicates(["name"]).orderBy("name").toLocalIterator())
                out.append(f"  {side}s: {', '.join(str(r.name) for r in rows)}")
                if verbose:
                    out += [f"    {r.name}: {'unknown' if r[vec] is None else ', '.join(f'{x:.6g}' for x in r[vec])}" for r in rows]
            for t in self.tables(s):
                meta = self._meta(f"{s}/{t}")
                dims = ", ".join(f"{meta['lengths'][a]} {a}" for a in meta["axes"])
                cells = meta.get("cells", 0)
                out.append(f"  {t} ({meta['kind']}): {dims}; {cells} cells, {100 * meta.get('flagged', 0) / max(cells, 1):.3f}% flagged")
                if verbose:
                    out += [f"    {a}: [{', '.join(map(str, self.coordinates(f'{s}/{t}', a)))}]" for a in meta["axes"]]
                    out += [f"    {k} = {v}" for k, v in sorted(meta.get("attrs", {}).items())]
                out += [f"    {h}" for h in meta.get("history", [])]
        return "\n".join(out)
