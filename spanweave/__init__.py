"""spanweave: code-knowledge-graph analytics and retrieval on Spark DataFrames."""
