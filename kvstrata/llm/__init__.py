"""Operators for preparing training data: sharding, search, cleaning, counting, packing and near-duplicate removal.

Nothing else in the library imports this package.
"""
