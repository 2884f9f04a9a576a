"""Operators for preparing training text: each module is one operator.

The functions that run inside tasks are shipped to the executors by value, so
a cluster needs no installed copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
