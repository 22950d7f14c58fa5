"""Operators for preparing language-model training data.

Functions that run in tasks are sent to the executors by value, so the executors need
the public libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
