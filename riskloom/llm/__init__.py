"""Operators for building training corpora; nothing else in the library imports this package.

Functions that run inside tasks are shipped by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
