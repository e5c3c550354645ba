"""Training-data operators over a ``documents``-like table.

Nothing else in the library imports this subpackage.  ``queries`` holds the
thin named queries; every other module holds one operator with a general
interface of its own.
"""
