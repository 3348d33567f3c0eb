"""corpusflow: corpus curation and analytics on PySpark DataFrames."""
