"""Operators for text corpora used as training data: cleaning, deduplication, scoring and encoding.

Functions of this subpackage travel to the tasks by value, so executors need
no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
