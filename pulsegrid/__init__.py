"""Signal and model-evaluation analytics on Spark.

Every public operator is a ``DataFrame -> DataFrame`` function.  Rows are keyed
by ids, never by position; "undefined" is NULL.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel to the executors with the task, so the package need not be
# installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
