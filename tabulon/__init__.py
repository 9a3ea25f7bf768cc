"""tabulon: spreadsheet-semantics analytics on Spark DataFrames."""
