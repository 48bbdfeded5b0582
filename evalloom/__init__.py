"""PySpark-native engine for evaluating retrieval-augmented question answering."""
