"""logvigil: security-telemetry investigation as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames.  One job handles any
number of investigations at once; rows belong to an investigation through the
``investigation_id`` column.
"""

__all__ = ["functions", "operators", "plans", "sources"]
