"""daymart: entity-per-day analytics as DataFrame-to-DataFrame Spark operators.

Every operator takes and returns Spark DataFrames and handles all entities in one
distributed job; picking one entity is an ordinary filter.
"""
