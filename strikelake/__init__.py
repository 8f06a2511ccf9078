"""Event-probability analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of the package: its few Python kernels travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
