"""Composed plans and the table of registered queries."""
