"""MapReduce-style analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames to DataFrames. Sub-packages:

* ``sources``   - file scans, format readers and writers
* ``functions`` - column expressions (no job of their own)
* ``operators`` - one module per family of operators
* ``plans``     - job chaining and the registered queries
* ``streaming`` - Structured Streaming jobs
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the Python workers as code, so executors
# need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
