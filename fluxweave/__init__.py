"""Spark-native analytics for multi-performer touch sessions.

Every operator takes DataFrames and returns a DataFrame; widths, thresholds
and column names are arguments, so the same code serves a ten-minute session
and a cluster-sized archive.
"""

import sys

from pyspark import cloudpickle

from fluxweave.session import build_session, shared_folder

# functions that run in Python workers travel with the job, so executors need
# no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "shared_folder"]
