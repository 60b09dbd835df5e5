"""Composed plans: text providers, tree search, phases, and the query catalogue."""
