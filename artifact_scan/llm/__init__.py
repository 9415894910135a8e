"""Operators for preparing language-model training data.

Each module holds one operator and its ``op<N>_<name>`` query; ``queries`` gathers
the registered queries and their SQL.  Nothing outside this package imports it.
"""
