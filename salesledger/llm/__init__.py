"""Operators for preparing text corpora. Nothing outside this folder imports it but the entry and the pipeline.

Functions of this package travel to the executors with the tasks that use them, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
