"""logweave: analytics over append-only knowledge logs, as plain Spark plans.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column expressions),
``operators`` (table to table), ``plans`` (composed queries and the registry),
``streaming`` (the same transformations on streams). The optional sub-package ``llm``
holds the training-data operators; nothing else imports it.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions go to Python workers by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
