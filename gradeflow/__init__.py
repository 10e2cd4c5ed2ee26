"""gradeflow: answer grading and corpus work on Spark.

Functions of this package that run inside tasks (Arrow and pandas functions)
are pickled by value, so executors need not have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
