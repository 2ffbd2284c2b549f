"""wholesail — event-sourced wholesale commerce analytics on Spark.

Layers (all lazy DataFrames; nothing is collected to the driver):

* ``sources``   — driver tables, the derived event log, table I/O
* ``functions`` — column functions (JSON payloads, casts, ids, dates)
* ``operators`` — projections, data quality, sampling, decisioning, cookbook
* ``plans``     — the query registry and its DuckDB oracle SQL
* ``streaming`` — Structured Streaming versions of the decision chain and windows
"""

__version__ = "0.1.0"
