"""Operators for corpora of training text.

Their functions travel to the executors with the job, so the workers need
numpy, pyarrow and the named libraries, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
