"""Table-generic analytics operators on PySpark DataFrames."""
