"""countloom: counting, scoring and curation jobs on Spark DataFrames."""
