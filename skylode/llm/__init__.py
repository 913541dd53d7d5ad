"""Operators for preparing language-model training data.

Nothing outside this folder imports it. ``queries.py`` holds the registered
queries, ``oracle.py`` the SQL they are compared with.
"""
