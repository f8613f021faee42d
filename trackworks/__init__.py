"""trackworks: PySpark operators over corpus manifests, signal blocks, segments, scores and run logs."""

import sys

from pyspark import cloudpickle

# kernels travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
