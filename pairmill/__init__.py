"""Spark jobs that turn raw rows of any shape into training shards, and score what comes of them."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions shipped to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
