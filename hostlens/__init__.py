"""hostlens: behavioural anomaly analytics over process telemetry, on Spark.

Every public function takes and returns DataFrames.  Nothing here starts a
job by itself except the sinks in ``sources`` and the stream starters in
``streaming``.
"""

from hostlens.config import Settings

__all__ = ["Settings"]

import sys

from pyspark import cloudpickle

# Functions and classes of this package travel to Python workers by value, so
# the workers need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
