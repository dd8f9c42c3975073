"""Training-data operators: fingerprints, classifiers, dedup, tokenization, packing, licences.

Nothing outside this subpackage imports it.
"""
