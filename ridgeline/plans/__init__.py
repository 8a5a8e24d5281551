"""Queries: callables over a folder of tables, each with its SQL where SQL can state it."""
