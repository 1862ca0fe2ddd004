"""Analytics on network KPI tables and streams, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
