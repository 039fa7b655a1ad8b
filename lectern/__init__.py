"""Corpus and instruction-data operators expressed as Spark DataFrame plans."""
