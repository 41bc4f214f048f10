"""Operators for preparing training text: thirteen operators, their queries and SQL.

Nothing else in the library imports this subpackage.
"""
