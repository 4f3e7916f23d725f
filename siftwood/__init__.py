"""siftwood: code and document intelligence as Spark plans."""

__version__ = "0.1.0"
