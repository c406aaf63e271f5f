"""Market-depth, usage, billing and access analytics as plain Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from depthspark.session import new_session, tune

# Functions sent to Python workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["new_session", "tune"]
