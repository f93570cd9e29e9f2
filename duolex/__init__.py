"""duolex: Spark jobs that prepare and score two-language text and code corpora."""

import sys

from pyspark import cloudpickle

# Python functions go to the executors whole: workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
