"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

One module per operator; ``queries`` registers them over the given tables.
The functions that run in Python workers travel with their tasks, so executors
need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
