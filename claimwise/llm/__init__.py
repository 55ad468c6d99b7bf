"""Training-data operators: near and exact dedup, scans, mixing, classifiers,
tokenising and vector search, each one a Spark job over whole tables.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries only when it can be imported.
"""
