"""Retrieval, feedback and evaluation analytics over whole tables with Spark."""

import sys

from pyspark import cloudpickle

# Helpers used inside Arrow functions travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
