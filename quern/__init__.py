"""quern: document retrieval and retrieval evaluation on PySpark DataFrames."""

__version__ = "0.1.0"
