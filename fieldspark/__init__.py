"""fieldspark: document collections to schema-conformant records, on Spark DataFrames."""

__version__ = "0.1.0"
