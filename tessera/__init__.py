"""Batch map/combine/partition/reduce analytics expressed as Spark DataFrame plans."""
