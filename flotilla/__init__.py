"""Fleet-inspection analytics as lazy PySpark DataFrame operators.

Subpackages: ``sources`` (table bindings, file readers and sinks), ``functions``
(column expressions and fixed values), ``operators`` (status, filters, dashboard,
search, ingest, report), ``plans`` (registered queries and their DuckDB oracle SQL)
and ``streaming`` (incremental ingest and fatigue alerts).
"""

__version__ = "0.1.0"
