import pickle

import numpy as np
import pytest

from solweave.model import Solutions
from solweave.sources import hdf5


def opener_of(path, mode="r"):
    """A file that acts like HDF5, kept as a pickle: groups, datasets with attributes, whole and by slices."""
    import os

    class Data:
        def __init__(self, data):
            self.data, self.attrs, self.shape = data, {}, data.shape

        def __getitem__(self, k):
            return self.data[k]

        def __setitem__(self, k, v):
            self.data[k] = v

    class Group(dict):
        def __init__(self):
            super().__init__()
            self.attrs = {}

        def require_group(self, name):
            return self.setdefault(name, Group())

        create_group = require_group

        def create_dataset(self, name, data=None, shape=None, dtype=None):
            self[name] = Data(np.zeros(shape, dtype) if data is None else np.asarray(data))
            return self[name]

    def pack(g):
        return {"attrs": dict(g.attrs), "items": {k: pack(v) if isinstance(v, Group) else (v.data, v.attrs) for k, v in g.items()}}

    def unpack(p):
        g = Group()
        g.attrs.update(p["attrs"])
        for k, v in p["items"].items():
            if isinstance(v, dict):
                g[k] = unpack(v)
            else:
                g[k] = Data(v[0])
                g[k].attrs.update(v[1])
        return g

    root = Group()
    if os.path.exists(path):
        with open(path, "rb") as f:
            root = unpack(pickle.load(f))

    def close():
        if mode == "a":
            with open(path, "wb") as f:
                pickle.dump(pack(root), f)

    root.close = close
    return root


def test_tables_go_there_and_back(spark, tmp_path, monkeypatch):
    def reader(path, mode="r", make=opener_of):
        return make(path, mode)

    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    path = str(tmp_path / "a.h5")
    rows = [(a, p, float(t), 1e8, 10.0 * t + i if (a, t) != ("B", 2) else None, 1.0) for i, a in enumerate("AB") for p in ("XX", "YY") for t in range(4) if (a, p, t) != ("A", "XX", 0)]
    t = Solutions.of(spark.createDataFrame(rows, "ant string, pol string, time double, freq double, val double, weight double"), ["time", "ant", "pol", "freq"], "phase", "phase000")
    ants = spark.createDataFrame([("A", [1.0, 2.0, 3.0]), ("B", None), ("A", [1.0, 2.0, 3.0])], "name string, position array<float>")
    hdf5.write_table(path, "sol000", t, ants, opener=lambda p: reader(p, "a"))
    assert hdf5.contents(path, reader) == {"sol000": ["phase000"]}
    side = {r.name: r.position for r in hdf5.read_side(spark, path, "sol000", "antenna", reader).collect()}
    assert side["A"] == [1.0, 2.0, 3.0] and all(np.isnan(side["B"])) and hdf5.read_side(spark, path, "sol000", "source", reader) is None
    monkeypatch.setattr(hdf5, "SLAB", 5)
    back = hdf5.read_table(spark, path, "sol000/phase000", reader)
    assert back.axes == ("time", "ant", "pol", "freq") and back.kind == "phase" and back.df.count() == 16
    got = {(r.ant, r.pol, r.time): (r.val, r.weight) for r in back.df.collect()}
    assert got.pop(("A", "XX", 0.0)) == (None, 0.0)
    assert got == {(a, p, x): (v, w) for a, p, x, _, v, w in rows}
    assert {(r.time, r.time__i) for r in back.df.collect()} == {(float(i), i) for i in range(4)}
    with pytest.raises(FileExistsError):
        hdf5.write_table(path, "sol000", t, opener=lambda p: reader(p, "a"))


def test_without_the_library(tmp_path):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="h5py"):
            hdf5.contents(str(tmp_path / "none.h5"))
