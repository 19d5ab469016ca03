"""Training-data operators (decontamination, near-duplicates, packing, ...).

Nothing else in the library imports this subpackage.
"""
