"""millrace: an analytics and data-processing engine on PySpark DataFrames."""
