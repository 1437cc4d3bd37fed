"""Operators for large training-data pipelines (documents and web pages).

Nothing else in the library imports this subpackage.  Every operator is a
``DataFrame -> DataFrame`` function with its own parameters; the registered
queries in ``queries.py`` apply them to whole tables.
"""
