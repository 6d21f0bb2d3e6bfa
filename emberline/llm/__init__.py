"""Training-data operators: deduplication, filters, classifiers, token counts and mixing.

Nothing outside this subpackage imports it.
"""
