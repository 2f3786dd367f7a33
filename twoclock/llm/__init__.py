"""Operators of a training-data pipeline over large text, page and vector tables."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so this package need not be installed
# there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
