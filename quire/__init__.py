"""Document-intelligence operators over PySpark DataFrames."""
