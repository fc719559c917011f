"""Operators for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# tasks carry the code they run, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
