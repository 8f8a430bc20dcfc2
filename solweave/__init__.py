"""Calibration-solution analytics as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel to the executors with the plan, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
