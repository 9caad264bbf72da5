"""A PySpark-native engine for deterministic, explainable decisions over tables of text, options and graphs."""
