"""girder: bill-of-materials, catalog and table-audit analytics on Spark DataFrames."""
