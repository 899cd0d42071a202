"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Queries and their SQL live in
``rankwright.llm.queries``.
"""
