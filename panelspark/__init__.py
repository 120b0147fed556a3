"""panelspark: chronological (no look-ahead) panel analytics as plain Spark jobs.

Every operator takes and returns DataFrames and is keyed by an entity, so the
work is partitioned by Spark.  Sub-packages:

* ``functions``  column expressions (text, dates, labels, tolerances)
* ``operators``  as-of joins, calendars, windows, aggregates, rules, metrics
* ``sources``    readers and writers
* ``plans``      composite pipelines built from the operators
* ``catalog``    the registered queries and their reference SQL
"""
