"""roadframe: table operators for road imagery, road networks and their feedback log, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
