"""Training-data operators: tokenising, extraction, quality, dedup, packing, media, LM scoring.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
when it is importable.
"""
