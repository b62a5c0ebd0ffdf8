"""quadrat: annotation, raster and manifest analytics as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors with the task, so that no executor needs an
# installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
