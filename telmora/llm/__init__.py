"""Operators that prepare training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
