"""Structured Streaming forms of intake, roll-up, compression and alerts.

The state functions of this package are shipped to the executors by value,
so a cluster needs no copy of it on the workers' import path.
"""

import sys

from pyspark import cloudpickle

import logsift.operators.pieces

for _module in (sys.modules[__name__], logsift.operators.pieces):
    cloudpickle.register_pickle_by_value(_module)
