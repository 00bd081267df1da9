"""Compositions of operators: stored tables between steps, and the registered queries."""
