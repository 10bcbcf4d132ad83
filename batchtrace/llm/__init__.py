"""Training-data operators: filtering, deduplication, mixing, packing, formatting of text corpora.

Nothing else in the library imports this subpackage; its queries are in ``llm.queries``.
"""
