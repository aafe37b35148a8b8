"""Corpus analytics on Spark: DataFrame-to-DataFrame operators for labelled text collections."""
