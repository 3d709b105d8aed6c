"""Operators for large training-data pipelines.

Thirteen operators, one module each, plus their registered queries (``queries``)
and DuckDB text (``oracles``).  Nothing else in the library imports this
subpackage.
"""

import sys

from pyspark import cloudpickle

# tasks get this subpackage's functions with their job, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
