"""DataFrame -> DataFrame building blocks.

All are lazy; only the optional size check of a lookup starts a (bounded) job.
"""
