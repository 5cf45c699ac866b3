"""Operators that prepare text for model training, each a Spark job."""

import sys

from pyspark import cloudpickle

# Functions go to the workers whole, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
