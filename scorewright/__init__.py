"""Scorecards and early-warning lists from entity-by-measure records, on Spark.

Sub-packages
------------
sources    reading, harmonising, replacing, upserting tables
functions  column expressions (text, numbers)
operators  profiling, quality, cleaning, star schema, joins, aggregates,
           ordering, statistics, segmentation, risk models, evaluation, actions
plans      reports composed from the operators, and read-only SQL
workload   the operators applied to the star-schema test tables
"""

__version__ = "0.1.0"
