"""Training-data operators: corpus-preparation components and their queries.

Nothing outside this folder imports it.  Worker functions travel by value, so
executors need the third-party libraries but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
