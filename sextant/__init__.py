"""Sextant: analytics over source code, documentation and runtime traces, as Spark plans.

Importing the package tells PySpark's serialiser to ship its functions by
value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
