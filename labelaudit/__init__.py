"""Label-quality work on HTTP traffic logs, as Spark DataFrame operators."""
import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so the executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
