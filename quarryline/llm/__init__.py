"""Training-data operators: sharding, tokens, near-duplicates, mixing, scans, search.

Every module offers DataFrame-in, DataFrame-out functions; ``catalog`` holds the
queries the driver runs. Nothing outside this sub-package imports it.
"""
