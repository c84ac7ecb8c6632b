"""Operators of a training-data pipeline: scoring, filtering, de-duplication, packing and binary output of documents.

Nothing else in the library imports this subpackage. Functions that run in Python workers travel by value, so the package
need not be installed on the executors (numpy, pyarrow and the libraries an operator names must be).
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
