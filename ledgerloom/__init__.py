"""A PySpark-native engine for artifact graphs, and operators for training-data corpora."""
