"""roadsky: how measured conditions relate to road incidents, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel with the job itself,
# so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
