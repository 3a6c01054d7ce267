"""Snapshots are rebuilt whole, so the library has no stream operators.

Its transformations are plain DataFrame functions; row-wise ones (``functions``)
may be applied to a streaming DataFrame as they are.
"""
