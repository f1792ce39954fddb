"""bitloom: a PySpark-native engine for text corpora, annotation documents and evaluation."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Tasks carry this package's code with them: executors need not have it on their paths.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
