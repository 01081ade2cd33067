"""Arabic text-correctness analytics on Spark DataFrames."""
