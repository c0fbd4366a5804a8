"""Building, auditing and querying corpora of bug/fix code pairs with Spark DataFrames."""
