"""tabscope: exploratory data analysis of Spark DataFrames of any size."""
