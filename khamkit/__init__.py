"""khamkit: Thai and multilingual text analytics on Spark DataFrames."""
