"""Spark-native harvest, specimen and effort analytics.

Layers, lowest first:

* ``functions``  column expressions (null rules, categories, bins, effort, dates)
* ``operators``  DataFrame -> DataFrame building blocks (joins, levels, grid, stats)
* ``sources``    schemas, readers, inline series and writers
* ``plans``      named pipelines composed from the layers above

Everything is lazy and expressed with Spark's own DataFrame primitives.
"""
