"""Operators for preparing large text, page, vector and media collections.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` binds them to the tables.
"""
