"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` registers
the thin queries over the driver's tables. Nothing outside this package imports it.
"""
