"""Training-data operators: fingerprints, language ID, web archives, nearest neighbours,
deduplication (suffix, line, near), tokenisation, toxicity and packing.

Nothing outside this subpackage imports it.
"""
