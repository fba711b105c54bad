"""lakesmith: data-quality, warehouse-modelling and analytics operators on Spark.

Every operator takes and returns DataFrames. Work runs as Catalyst plans
(joins, aggregates, windows) or Structured Streaming queries; Python only
builds expressions on the driver. Time is always an explicit ``as_of``.
"""

__version__ = "0.1.0"
