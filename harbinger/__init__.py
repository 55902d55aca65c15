"""Spark-native analysis of emerging topics in a dated text corpus.

Every operator is a function that takes and returns DataFrames.  Operators are lazy
except where their docstring says that they run a bounded job of their own.
"""
