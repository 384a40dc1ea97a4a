"""millrace: curation of training datasets as Spark DataFrame operators."""

__version__ = "0.1.0"
