"""tesela: lexicometric and discourse analysis on Spark DataFrames."""
