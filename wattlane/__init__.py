"""Load-curve analytics on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, windows, joins and MLlib estimators.  Column names are
parameters, so the same operators run on metered energy data and on the
stand-in tables used by the tests.

Sub-packages
------------
``sources``    table scans (NaN -> NULL), GML / polygon readers, sinks, stand-ins
``functions``  column expressions: calendar, missing-value rules, geometry
``operators``  rolling statistics, profiles, daily aggregates, joins, scaling,
               clustering, splits, models, metrics, spatial join
``plans``      the three task pipelines and the query catalogue
``streaming``  the cleaning and daily aggregation run on a stream source
"""

__version__ = "0.1.0"
