"""Queries over the tables, with equivalent SQL."""
