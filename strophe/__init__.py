"""strophe: a Spark-first engine for building, linking and auditing record, text and sequence collections."""

import sys

from pyspark import cloudpickle

# Workers of a cluster need not have this package installed: functions that run
# in Python workers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
