"""Training-data operators: text, page and vector preparation as Spark jobs.

Nothing outside this package imports it.
"""
