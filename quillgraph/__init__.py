"""quillgraph: document-to-knowledge-graph analytics on Spark DataFrames."""
