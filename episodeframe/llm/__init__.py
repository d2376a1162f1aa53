"""Training-data operators: mixing, fingerprints, dedup, scoring, tokens.

Nothing else in the library imports this subpackage.
"""
