"""Operators for preparing text corpora at training scale.

Nothing outside this subpackage imports it; deleting the folder (with
``corpus_pipeline.py`` and ``tests/llm``) leaves the rest of the library whole.
"""
