"""chunkwright: a PySpark-native engine for keyed, time-indexed data, its features, scores and highlight segments."""
