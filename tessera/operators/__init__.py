"""Relational and iterative operators."""
