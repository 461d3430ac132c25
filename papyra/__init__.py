"""papyra: a Spark-native engine for paper-corpus retrieval.

Papers, authors, categories and vectors live as DataFrames; every operator is
a function from DataFrames to a DataFrame, so Catalyst sees whole plans.
"""

__version__ = "0.1.0"
