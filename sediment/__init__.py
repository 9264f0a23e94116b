"""Layered tables on Spark: raw files -> Raw -> Bronze -> Silver, plus the registry around them.

Operators are functions from DataFrame to DataFrame.  The jobs in `sediment.plans` combine them,
write the tables and return the counts of the run.
"""
