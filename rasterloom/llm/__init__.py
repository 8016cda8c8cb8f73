"""Training-data operators: deduplication, scoring, scanning, packing, sharding.

Nothing else in the library imports this subpackage.
"""
