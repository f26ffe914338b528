"""Operators for preparing training text. Nothing else in the library imports this package.

Functions that run inside tasks travel to the executors by value, so that a job also works
where only the driver has the package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
