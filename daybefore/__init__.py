"""Point-in-time analytics for two-sided event histories, as Spark DataFrame operators.

The one rule everywhere: a value attached to date ``d`` is computed from rows dated
strictly before ``d``.  See README.md for the design.
"""
