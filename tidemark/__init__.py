"""tidemark: analytics over daily market bars and similar keyed series, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
