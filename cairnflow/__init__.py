"""cairnflow: a PySpark-native engine for reasoning-data synthesis and analysis.

Search trees, trajectories, contrastive pairs, critiques and verified solutions are DataFrames;
operators are functions from DataFrames or Columns to DataFrames or Columns.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
