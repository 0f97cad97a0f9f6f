"""Operators for preparing training data: deduplication, cleaning, filtering, sharding and packing of texts.

Task functions are shipped with the job, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
