"""sixfold: knowledge-graph analytics over DataFrames, keyed by 6-bit hypercube codes."""
