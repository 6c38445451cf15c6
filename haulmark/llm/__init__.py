"""Operators for preparing language-model training data.

One module for each operator, ``queries`` binds them to the test tables. Nothing else in
the library imports this package.
"""
