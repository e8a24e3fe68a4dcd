"""Binds the operators to the test tables: bridge views, queries and their SQL twins."""
