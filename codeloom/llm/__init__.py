"""Training-data operators: deduplication, tokenisation, packing, search and filters.

Nothing outside this folder imports it; the rest of the library works without it.
"""
