"""driftmill: contract-change risk analytics expressed as Spark DataFrame plans."""
