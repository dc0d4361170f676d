"""taskmill: build and score multilingual instruction corpora with Spark DataFrames."""
