"""Amplitudes and phases of a beam model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from solweave.model import Solutions


def fill_beam(table: Solutions, model: Callable[[str, np.ndarray, np.ndarray], np.ndarray] | None = None) -> Solutions:
    """Replace amplitudes (phases) of XX and YY by the absolute values (angles) of a beam's first and last Jones elements.

    ``model(station, time, freq)`` returns complex[n, 2, 2]; without one a beam library must be installed.
    """
    if model is None:
        raise RuntimeError("no beam library is installed; give a model")
    if not (table.is_amplitude or table.is_phase):
        raise ValueError("amplitudes or phases")
    phase = table.is_phase

    @F.pandas_udf("double")
    def value(ant: pd.Series, pol: pd.Series, time: pd.Series, freq: pd.Series) -> pd.Series:
        out = np.full(len(ant), np.nan)
        for name, at in ant.groupby(ant).indices.items():
            jones = model(name, time.to_numpy()[at], freq.to_numpy()[at])
            g = np.where(pol.to_numpy()[at] == "XX", jones[:, 0, 0], jones[:, 1, 1])
            out[at] = np.angle(g) if phase else np.abs(g)
        return pd.Series(out)

    new = value("ant", "pol", F.col("time").cast("double"), F.col("freq").cast("double"))
    return table.put(table.df.withColumn("val", F.when(F.col("pol").isin("XX", "YY"), new).otherwise(F.col("val"))))
