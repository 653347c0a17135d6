"""riskgrid: spatio-temporal risk analytics as lazy PySpark plans."""

import sys

from pyspark import cloudpickle

# The few vectorised functions travel to executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
