"""matweft: dense matrix analytics and corpus preparation on Spark DataFrames."""
