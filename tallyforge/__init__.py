"""tallyforge: bookkeeping operators over Spark DataFrames."""
