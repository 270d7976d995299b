"""karst: a document analytics engine on Spark DataFrames."""
