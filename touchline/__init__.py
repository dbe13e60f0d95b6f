"""Match analytics on Spark: leak-free form features, ratings, goal models and scoring as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
