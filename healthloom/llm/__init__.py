"""Operators of a training-data pipeline, one module each.

Nothing outside this subpackage imports it.  ``entry`` holds the registered
queries and their SQL; every other module is a general operator.
"""
