"""Sextant: retrieval and knowledge-graph analytics as Spark DataFrame plans."""
