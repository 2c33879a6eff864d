"""Document and question/answer analytics on Spark DataFrames."""
