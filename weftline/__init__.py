"""Text-similarity and program-graph analytics expressed as Spark DataFrame plans."""
