"""Training-data operators: mixing, archives, tokenizers, near-duplicates, filters, search.

Nothing else in the library imports this subpackage.
"""
