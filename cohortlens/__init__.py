"""cohortlens — tabular risk analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (or an Estimator-style
``fit`` returning a small parameter table plus a ``transform`` that applies it
as column expressions).  Heavy work stays in Catalyst/Tungsten; only bounded
parameter tables (one row per column, per model or per threshold) reach the
driver.
"""

__version__ = "0.1.0"
