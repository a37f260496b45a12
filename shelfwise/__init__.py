"""Price intelligence jobs on Spark: catalogue, pages, matching, price history and reports as DataFrames."""
