"""Code-retrieval analytics and training-data operators on PySpark DataFrames."""
