"""Spark-native analysis of coded survey microdata.

Layers:

* ``sources``   -- readers for the input tables and the ``survey`` view
* ``functions`` -- Column-level helpers (null-safe code predicates,
  calendar fields from packed ids, equal-width bin expressions)
* ``operators`` -- DataFrame -> DataFrame building blocks: profiling,
  cleaning, monthly means, distributions, splits, metrics, models,
  cross-validation with a fold log, comparison tables
* ``plans``     -- plan-level helpers: bounded broadcasts, lineage cuts,
  plan inspection
* ``streaming`` -- the monthly means as an incremental streaming query

Every operator takes DataFrames plus column names and returns a
DataFrame; nothing is collected to the driver except model parameters
and per-fit metrics, whose size is bounded by the parameter grid.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
