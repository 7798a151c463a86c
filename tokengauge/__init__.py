"""Token-count estimation over text corpora, written for PySpark."""
