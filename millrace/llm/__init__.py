"""Training-data operators: quality, duplicates, contamination, models, packing, pages and archives.

Nothing outside this subpackage imports it.
"""
