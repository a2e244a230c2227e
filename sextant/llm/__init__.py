"""Operators for language-model data; optional, imported by nothing else in the library.

This subpackage uses only PySpark and the general helpers of ``sextant``.
"""
