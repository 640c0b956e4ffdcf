"""Entity-event graph analytics and data preparation on Spark DataFrames."""
