"""quire: a PySpark-native engine for long-form document processing.

Functions that run inside Python workers are shipped by value, so executors
need only PySpark and the third-party libraries, not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
