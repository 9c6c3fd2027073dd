"""Training-data operators: tokenising, filtering, near-duplicate joins, media and packing.

Nothing outside this subpackage imports it.
"""
