"""DuckDB SQL twins of the registered Spark queries (the correctness oracle).

The SQL is written independently of the Spark code path: it is plain ANSI /
DuckDB SQL over the pre-registered test-table views.  ``base.py`` holds the
shared CTE chain (raw bindings -> clean layer -> warehouse); ``sql.py`` holds
one final SELECT per query name.
"""
