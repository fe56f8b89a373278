"""Training-data operators: deduplication, filtering, classification, packing.

Nothing else in ``skyloom`` imports this subpackage; it may be deleted without
affecting the gridded-data engine.
"""
