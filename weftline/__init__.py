"""weftline: document-to-rule analytics on Spark DataFrames."""
