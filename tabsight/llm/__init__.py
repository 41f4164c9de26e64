"""Operators for preparing text corpora: ten operators, their queries and their SQL.

Nothing else in the library imports this subpackage.
"""
