"""Temporal cohort analytics on Spark: cohort predicates, evidence, and series operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
