"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it is present.  Every operator takes a ``documents``-shaped
DataFrame (column names are parameters), keeps its own general interface, and
defines in its docstring what nulls, empty texts, ties, repeated rows and
empty tables give.
"""
