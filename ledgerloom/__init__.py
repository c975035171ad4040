"""ledgerloom: liquidity and credit-risk table operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Grouped functions travel to the executors by value: no install step is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
