"""Compositions of operators: index build, hybrid search, change validation."""
