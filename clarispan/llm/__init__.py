"""Training-data operators: ten Spark jobs over a corpus of documents.

Nothing outside this subpackage imports it.
"""
