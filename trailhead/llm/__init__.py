"""Operators for preparing training data: sharding, language, near copies, repeats, leaks, quality, secrets, mixing, URLs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
