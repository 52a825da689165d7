"""Operators for preparing text corpora, each a Spark job over whole tables."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code, which therefore need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
