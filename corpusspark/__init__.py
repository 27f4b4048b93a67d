"""Corpus analytics on PySpark: catalog, chunking, retrieval and training-data preparation as DataFrame plans."""
