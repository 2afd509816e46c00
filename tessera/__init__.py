"""tessera: text and interval analytics expressed as PySpark DataFrames."""
