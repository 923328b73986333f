"""markloom: a PySpark engine for HTML corpora."""

__version__ = "0.1.0"
