"""weft: a Spark-first engine for agent-interaction data and training corpora.

Functions of this package travel to Spark's Python workers by value, so workers
need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"
cloudpickle.register_pickle_by_value(sys.modules[__name__])
