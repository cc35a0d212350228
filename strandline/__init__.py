"""strandline: lineage and evidence-linking analytics on Spark DataFrames."""
