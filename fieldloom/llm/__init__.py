"""Training-data operators: deduplication, packing, quality, language, mixing, joins and search.

Nothing outside this subpackage imports it; ``fieldloom.llm.registry`` offers its queries.
"""
