"""claimwise — motor-insurance claims analytics as Spark DataFrame plans.

Layers:
  functions/  Column -> Column cleaning expressions (strings, numbers, dates)
  sources/    scans, bindings over the test tables, CSV upload parsing, sinks
  operators/  reusable DataFrame operators (quantiles, dedup, tiers, KPIs, windows)
  plans/      end-to-end jobs: clean layer, warehouse, scoring runs, forecast, audit
  streaming/  Structured Streaming variants (incremental ingest, login monitor)
  models/     Spark ML training / scoring and grouped time-series fits
"""

__all__ = ["session", "contracts"]

import sys as _sys

try:  # ship the package's pandas-UDF code with each task: executors need no install
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference pickling
    pass
