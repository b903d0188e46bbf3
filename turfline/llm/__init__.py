"""Operators for training-data pipelines: linkage, survivorship, sketches, similarity and corpus hygiene.

Nothing outside this subpackage imports it.
"""
