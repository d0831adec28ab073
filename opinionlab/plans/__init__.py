"""Compositions of operators: table processing, gates, delivery checks."""
