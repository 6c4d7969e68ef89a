"""Tag-vote taxonomy induction on Spark DataFrames."""
