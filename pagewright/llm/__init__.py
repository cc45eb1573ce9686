"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage. ``registry`` holds the
``opN_<name>`` queries and their SQL.
"""
