"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``codequarry.llm.queries`` lists
what the driver entry registers.
"""
