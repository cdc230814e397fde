"""Operators of a training-data pipeline: languages, pages, urls, licences, leaks, mixtures, duplicates, quality."""

import sys

from pyspark import cloudpickle

# Functions travel with the tasks: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
