"""Training-data operators: filtering, deduplication, mixing, tokenising, formatting, media.

Nothing outside this subpackage imports it. ``ledgerflow.llm.registry`` lists its queries.
"""
