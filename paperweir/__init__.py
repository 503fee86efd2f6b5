"""paperweir: document-readiness and exposure analytics expressed as Spark DataFrames."""
