"""Spark-native engine for forecasting many time series at once."""

import sys as _sys

# Python UDFs and grouped-map functions of this package are pickled by
# value, so executors need pyspark, numpy, pandas and pyarrow, not the
# package itself.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with addPyFile
    pass
