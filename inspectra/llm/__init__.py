"""Operators for training data: survivorship, addresses, linkage, packing, leakage and spam pages.

Nothing outside this subpackage imports it.
"""
