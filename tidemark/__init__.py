"""Tidemark: reconcile replicated document stores with Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` function on the table schemas in
:mod:`tidemark.schemas`; streaming forms live in :mod:`tidemark.streaming`.
"""

__version__ = "0.1.0"
