"""Operators for large training-data pipelines, one module each.

Nothing outside this subpackage imports it.  ``bindings`` holds the registered queries and
their SQL; every operator module has a general interface of its own.
"""
