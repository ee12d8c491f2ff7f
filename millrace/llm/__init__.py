"""Training-data operators: decontamination, token counts, deduplication, packing, sharding, selection.

Nothing outside this package imports it.
"""
