"""Functions that run inside tasks on Arrow batches; they are shipped with the task, so executors need no copy."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
