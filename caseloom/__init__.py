"""Decision deferral analytics as Spark jobs.

Every operator takes and returns DataFrames.  Scenario axes (alert rate, training share, cost
ratio, seed, environment, batch) are key columns, so one job covers a whole experiment grid.
"""

__version__ = "0.1.0"
