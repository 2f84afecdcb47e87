"""Readers of artifacts and writers of graphs."""
