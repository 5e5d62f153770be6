"""tessera: a PySpark engine for preparing and evaluating text-embedding data."""

__version__ = "0.1.0"
