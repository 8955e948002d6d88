"""Relational operators: search, ranking, graph, planning."""
