"""Operators for building language-model training data, one module each.

Nothing outside this subpackage imports it; its queries and oracle SQL are in
:mod:`spanforge.llm.catalog`.
"""
