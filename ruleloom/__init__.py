"""Spark-native engine for rule documents: lexing, typed graphs, partitioning, packets and checks."""
