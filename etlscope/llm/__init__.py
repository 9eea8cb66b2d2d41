"""Operators for preparing training data; nothing else in the package imports this subpackage.

Functions that run on executors are pickled by value, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
