"""Training-data operators: decontamination, near-duplicate search, line and
substring deduplication, language and license labels, language-model scores,
packing, preference formatting and vector search.

Nothing else in the library imports this subpackage.
"""
