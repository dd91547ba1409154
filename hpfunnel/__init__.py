"""hpfunnel: proposal-funnel analytics on Spark DataFrames, SQL and Spark ML.

Sub-packages: ``sources`` (adapter, typed ingest, sinks), ``functions``
(column expressions), ``operators`` (aggregations, joins, windows, models),
``plans`` (registered queries and their SQL oracles), ``streaming`` (none).
"""

__version__ = "0.1.0"
