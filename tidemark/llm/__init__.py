"""Operators for building language-model training data: near-duplicate search, filters, packing,
mixing, token stores, page text and audio fingerprints.

Nothing outside this subpackage imports it.
"""
