"""Review analytics on Spark: cleaning, vector roll-ups, scoring, ranking and corpus reports.

Every operator takes and returns DataFrames (or Columns); nothing is computed until the caller asks for it.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# the few Arrow functions travel with the plan, so executors need no installed copy of this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
