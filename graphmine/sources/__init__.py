"""Graphs from text, edge lists and relational tables; exports to text."""
