"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` in
``strandloom.llm.registry`` are what the driver entry point picks up.
"""
