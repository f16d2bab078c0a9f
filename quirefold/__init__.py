"""Document-graph analytics on Spark: decode, check, summarise, render and bundle corpora of documents."""
