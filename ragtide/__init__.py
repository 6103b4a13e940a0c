"""ragtide — document retrieval and answer-quality jobs as Spark DataFrame plans.

Every operator takes DataFrames and returns a DataFrame (or a Structured
Streaming query).  The driver sees only size-checked batches and bounded summaries.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package used inside UDFs are pickled by value, so Python workers
# need not import the package (it travels with each task, no file distribution).
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from ragtide.session import get_session, checkpoint_dir  # noqa: E402

__all__ = ["get_session", "checkpoint_dir"]
