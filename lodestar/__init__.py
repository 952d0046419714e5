"""lodestar: literature-graph analytics expressed as Spark DataFrame plans."""
