"""staysift: place search, listing curation and text retrieval as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
