"""dqspark: a data-quality engine on Spark DataFrames.

profile -> exact dedup -> near-duplicate dedup -> repair -> anomaly flags ->
quality score, each a function from DataFrames to DataFrames.
"""

import sys

try:  # ship this package's Python code with each task: executors need no install
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__version__ = "0.1.0"
