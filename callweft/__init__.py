"""Code-graph analytics on Spark: facts, ranked lookups, bounded traces and catalogs as DataFrames."""
