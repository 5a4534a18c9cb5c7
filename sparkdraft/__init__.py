"""sparkdraft: DataFrame operators for distillation data prep and
speculative-decoding run analytics, built on Spark SQL.

Every public operator is a function ``DataFrame -> DataFrame`` (or a
``Column`` expression builder); nothing holds a global session.
"""

import sys as _sys

__version__ = "0.1.0"

# Python code shipped to tasks (pandas UDFs, mapInPandas/applyInPandas
# functions) is serialized by value, so executors need not have this
# package on their path (a driver that imports it from a local checkout
# still works). On a cluster the package can equally be shipped with
# --py-files; by-value pickling keeps both working.
try:  # pragma: no cover - depends on the installed PySpark
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
