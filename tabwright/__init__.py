"""Tabular features, fidelity and privacy audits on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions by value: executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
