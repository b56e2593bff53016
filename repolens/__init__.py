"""repolens: repository-operations analytics as PySpark table operators."""

# Functions run in Python workers (mapInPandas) are shipped by value, so
# executors need no installed copy of this package.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: the package must then be on the executors' path
    pass
