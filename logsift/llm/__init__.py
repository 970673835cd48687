"""Training-data operators: dedup, filters, scans, encoding and packing.

The task functions of this package are shipped to the executors by value,
so a cluster needs no copy of it on the workers' import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
