"""Training-data operators: sharding, filtering, deduplication, tokenization, packing.

Nothing else in the package imports this subpackage; it can be deleted with
``tests/llm`` and ``corpus_pipeline.py`` and the rest still works.
"""
