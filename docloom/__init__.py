"""A document-to-Markdown analytics engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
