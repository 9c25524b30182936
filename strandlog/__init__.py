"""A PySpark engine for append-only, versioned event logs and the data work around them.

Every operator is a function from DataFrames to DataFrames.  Nothing here imports the
optional text subpackage; it can be removed without a trace.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
