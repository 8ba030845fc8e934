"""kinweave: collective entity matching as Spark DataFrame programs."""

__version__ = "0.1.0"
