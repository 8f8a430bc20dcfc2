import numpy as np
import pytest
from pyspark.sql import functions as F

from solweave.functions.scalar import TEC_PHASE
from solweave.model import Solutions
from solweave.operators import fits
from solweave.plans import runner
from solweave.sources.store import Store


def test_channels_count_by_the_noise_of_the_low_band(spark, tmp_path):
    assert fits.SENSITIVITY.shape == (100, 2) and fits.SENSITIVITY[:, 1].max() == 1
    assert fits.SENSITIVITY[0] == pytest.approx([28.5e6, 18965.54359589192609 / 29940.30080626945710])
    freqs, rng = np.linspace(20e6, 60e6, 80), np.random.default_rng(1)
    lost = np.where(freqs < 28.5e6, rng.normal(0, 1.5, 80), 0.0)  # below the table nothing is received
    rows = [("CS001", float(t), float(f), float(p), 1.0) for t in range(3) for f, p in zip(freqs, TEC_PHASE * 0.02 / freqs + lost, strict=True)]
    x = Solutions.of(spark.createDataFrame(rows, "ant string, time double, freq double, val double, weight double"), ["ant", "time", "freq"], "phase")
    assert [r.val for r in fits.tec(x).df.collect()] == pytest.approx([0.02] * 3, abs=1e-6)
    assert abs(fits.tec(x, sensitivity=()).df.first().val - 0.02) > 1e-4
    low = x.put(x.df.filter("freq < 28.5e6"))
    assert {r.weight for r in fits.tec(low).df.collect()} == {0.0}
    s = Store(spark, str(tmp_path / "s"), "a")
    s.make_solset()
    still = x.df.withColumns({"ant": F.lit("CS000"), "val": F.lit(0.0)})  # the reference that is looked for: as good as any, and first by name
    s.make_table("sol000", x.df.unionByName(still), ["ant", "time", "freq"], "phase")
    step = "soltab = sol000/phase000\n[t]\noperation = TEC\nsoltabOut = {}\nsensitivity = {}\n"
    for name, how in (("tec001", ""), ("tec002", "equal"), ("tec003", "[28e6, 0, 28.6e6, 1]")):
        assert len(runner.run(step.format(name, how), s)) == 1
    got = [s.table(f"sol000/{n}", ant="CS001").df.first().val for n in ("tec001", "tec002", "tec003")]
    assert got[0] == pytest.approx(0.02, abs=1e-6) and abs(got[1] - 0.02) > 1e-4 and got[2] != got[0]
