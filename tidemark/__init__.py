"""Document, key-value and change-log analytics expressed as Spark plans."""

__version__ = "0.1.0"
