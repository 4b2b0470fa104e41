"""Document-intelligence jobs over corpora of court opinions, built on Spark DataFrames."""
