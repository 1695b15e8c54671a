"""Operators for preparing language-model training data.

Each module holds one operator with a general DataFrame interface;
``queries`` registers the thin ``opN_<name>`` queries over the driver's tables.
Nothing outside this subpackage imports it.
"""
