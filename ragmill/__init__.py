"""ragmill: building, searching and measuring large text corpora with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry their code along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
