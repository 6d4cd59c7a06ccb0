"""A retrieval and analytics engine on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers then need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
