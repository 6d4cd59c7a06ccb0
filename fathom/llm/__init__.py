"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``registry`` holds the queries that apply them to whole tables.
"""

import sys

from pyspark import cloudpickle

# Python workers then need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
