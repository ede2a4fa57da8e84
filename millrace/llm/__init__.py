"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; text is read whole, and no operator keeps state on the driver that
grows with the number of documents.
"""
