"""Registered queries: each operator on the given tables, with an equivalent SQL text where one exists."""
