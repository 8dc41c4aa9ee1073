"""Network-fault analytics on Spark: topology, alarm propagation, metric series, root causes, evaluation."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
