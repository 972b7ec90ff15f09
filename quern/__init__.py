"""quern: relation-and-event analytics on PySpark.

Functions that Spark ships to Python workers are sent by value, so executors
need Spark and the scientific libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
