"""Research-radar analytics on PySpark.

Every operator is a plain function from DataFrames (plus parameters) to a
DataFrame.  Nothing here reads the wall clock: operators that look back in time
take an explicit ``as_of``.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
