"""Training-data operators: dedup, filtering, extraction, tokenising, packing.

Nothing outside this subpackage imports it; the queries over the text tables
live in :mod:`silvatrix.llm.queries`.
"""
