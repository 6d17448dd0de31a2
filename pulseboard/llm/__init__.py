"""Training-data operators: thirteen large-corpus operators built on Spark jobs.

Every operator takes DataFrames and returns DataFrames; ``queries`` holds the
thin registered ``opN_`` queries that derive their digest columns from them.
"""
