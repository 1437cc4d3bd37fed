"""ordo: analytics over ordered event tables and streams on Spark.

Every operator is a DataFrame -> DataFrame function built from window frames,
aggregates, joins and keyed state, so Catalyst plans and distributes it.
"""

__version__ = "0.1.0"
