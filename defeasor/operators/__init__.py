"""Relational, graph and analytical operators."""
