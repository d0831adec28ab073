"""opinionlab: auditable analysis of comment and opinion tables on Spark DataFrames."""
