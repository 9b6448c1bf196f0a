"""bibspark: bibliographic search and record linkage as PySpark DataFrame plans."""

__version__ = "0.1.0"
