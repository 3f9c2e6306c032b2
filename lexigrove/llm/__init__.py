"""Operations for large training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions and classes of this subpackage travel with the jobs, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
