"""canopia: forest laser-scanning and tree-structure analytics as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
