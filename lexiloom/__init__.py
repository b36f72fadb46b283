"""Corpus analytics on Spark: text hierarchies, sequences, information measures, null models and training-data operators."""
