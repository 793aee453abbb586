"""Research-data metadata catalogs as Spark DataFrames."""
