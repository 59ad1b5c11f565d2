"""vecloom: a PySpark-native engine for dense-vector analytics.

Executors need no installation of this package: what runs in Python workers is
pickled by value with the task.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
