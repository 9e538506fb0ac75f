"""Operators of a training-data pipeline: deduplication, joins on shingles, decontamination, classifiers,
tokenizers and search. Nothing else in the library imports this subpackage.

Functions that run inside tasks are shipped with the task, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
